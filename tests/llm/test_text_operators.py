import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import leaks, lookalikes, packing, pieces, scans, splits, truncation

LONG = "长" * 300_000


# --- look-alikes -----------------------------------------------------------------
def test_unified_texts_equal_pythons_normal_form(spark):
    texts = ["Ｃａｓｈ　ｆｌｏｗ", "Résultat", "ạ̇b", "ȩ́", "​商⁠誉﻿", "⾦额", "", "plain", "ạ̇", "Å", "x" * 50_000, "한국어", "　", "ﬁn"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)] * 2, "t string")
    got = dict(lookalikes.unify_texts(df, "t").collect())
    for t in texts:
        want = " ".join(unicodedata.normalize("NFKC", "".join(c for c in t if not lookalikes._unseen(c))).split())
        assert got[t] == want, t
    assert len(got) == len(set(texts)) and lookalikes.unify_texts(df.limit(0), "t").count() == 0


def test_lookalikes_found(spark):
    labels = spark.createDataFrame([("营业收入",), ("ERP系统投入",), ("Total",), ("β系数",), (None,)], "label_text string")
    rows = [(1, "营业收入", "label"), (2, "营业收入 ", "label"), (3, "ЕRР系统投入", "label"), (4, "Tоtal", "label"), (5, "Total (restated)", "label"), (6, "ꞵ系数", "label"), (7, "１２．５", "figure"), (8, "12.5", "figure"), (9, "n/a", "figure"), (10, "－５％", "figure"), (11, None, "label"), (12, LONG, "label"), (2, "营业收入 ", "label")]
    cells = spark.createDataFrame([("t", i, "f", t, k, "extra") for i, t, k in rows], "record_table string, record_id long, field_name string, text string, kind string, plain string")
    got = {r["record_id"]: r["plain_text"] for r in lookalikes.find_lookalikes(cells, labels).collect()}
    assert got == {2: "营业收入", 3: "ERP系统投入", 4: "Total", 6: "β系数", 7: "12.5", 10: "-5%"}
    assert lookalikes.find_lookalikes(cells.limit(0), labels).count() == 0 and lookalikes.find_lookalikes(cells.where("record_id < 7"), labels.limit(0)).count() == 0


# --- scans -----------------------------------------------------------------------
def test_page_numbers():
    for s, page in (("第十三页", 13), ("- 12 -", 12), ("Page l2 of 40", 12), ("xii", 12), ("12 | 56", 12), ("P.9", 9), ("页码：3/29", 3), ("第 ll 页 共 42 页", 11)):
        assert scans.page_number(s, page, page + 1), s
        assert not scans.page_number(s, page + 5, page + 6), s
    for s in ("（12）", "- 12", "12.", "注12：见附注", "Note 12", "1,200", "12%"):
        assert not scans.page_number(s, 12, 13), s


def test_noise_and_repair(spark):
    body = "本年度公司营业收入为100元，同比增长，管理层认为风险可控。"
    rows = [(i, f"某某{i % 3}股份2024年度报告\n{body}\nThe committee has reviewed the estimate again and\nfurther adjustments remain possible, up 5% year-on-year.\n第{i + 3}页", i + 3, f"d{i}") for i in range(40)]
    noisy = "某某0股份2024年度报告\n本年度公司营业收人为1O0元，同比增长，管理层认为风险可控。\nThe comrnittee has reviewed the esti-\nmate again and further adjust¬\nments remain possible year-\non-year.\n第7页\n（8）"
    hits = spark.createDataFrame(rows + [(100, noisy, 7, "d100"), (100, noisy, 7, "d100"), (101, None, 1, "d"), (102, "", None, None), (103, "word " * 50_000, 1, "d")], "hit_id long, text string, page_start int, document_key string").withColumn("top", F.lit("clash")).withColumn("kind", F.lit(1))
    quality = spark.createDataFrame([(f"d{i}", i + 3, "native", 0, False) for i in range(40)], "document_key string, page_number int, extraction_route string, ocr_char_count int, needs_ocr boolean")
    got = {(r["line_no"], r["kind"]) for r in scans.find_noise(hits, quality).where("hit_id = 100").collect()}
    assert {(1, "running_header"), (3, "broken_word"), (4, "broken_word"), (7, "page_number"), (2, "misread")} <= got
    assert not {(5, "broken_word"), (8, "page_number")} & got
    clean = scans.repaired_texts(hits, quality)
    text = clean.where("hit_id = 100").first()["repaired_text"]
    assert "estimate again" in text and "adjustments" in text and "年度报告" not in text and "第7页" not in text and "营业收入为100元" in text
    assert clean.where("hit_id = 101").first()["repaired_text"] is None and clean.count() == 44
    assert scans.find_noise(hits.limit(0), quality).count() == 0


# --- splits ----------------------------------------------------------------------
def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for x in list(root):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("kind", ["path", "random", "star", "empty"])
def test_components_against_brute_force(spark, kind):
    rng = random.Random(1)
    edges = {"path": [(str(i), str(i + 1)) for i in range(60)], "random": [(str(rng.randint(0, 99)), str(rng.randint(0, 99))) for _ in range(70)], "star": [("hub", str(i)) for i in range(200)] + [("a", "a")], "empty": []}[kind]
    df = spark.createDataFrame(edges + [(None, "x")], "a string, b string")
    got = {}
    for node, root in splits.connected_components(df).collect():
        got.setdefault(root, set()).add(node)
    assert {frozenset(g) for g in got.values()} == brute_components(edges)


def _manifests(spark):
    source = [("k1", "F1", "甲 公司", "x"), ("k2", "F1", None, "x"), ("k3", "F2", "＊ＳＴ甲公司", "x"), ("k4", None, "乙", "x"), ("k5", None, None, "x"), ("k4", None, "乙", "x"), (None, "F9", "丙", "x")]
    versions = [("k1", "calibration", "v1"), ("k2", None, "v2"), ("k3", "dev", "v3"), ("k4", "dev", "v4"), ("k5", None, "v5"), ("k6", None, "v6"), ("k1", "calibration", "v1"), (None, "dev", "v7")]
    return spark.createDataFrame(versions, "document_key string, split string, version_id string").withColumn("root", F.lit("clash")), spark.createDataFrame(source, "document_key string, security_code string, company_name string, status string")


def test_split_conflicts_and_assignment(spark):
    versions, source = _manifests(spark)
    assert set(splits.split_conflicts(versions, source).collect()) == {("v1", "F1"), ("v3", "F1")}
    targets = spark.createDataFrame([("calibration", 0.5), ("dev", 0.5)], "split string, proportion double")
    records, table = splits.assign_splits(versions, source, targets)
    got = {r["version_id"]: r for r in records.collect()}
    assert len(got) == 7 and len({got[v]["split"] for v in ("v1", "v2", "v3")}) == 1 and got["v1"]["status"] == "quarantined"
    assert got["v4"]["split"] == "dev" and got["v4"]["status"] == "kept" and all(r["split"] in ("calibration", "dev") for r in got.values())
    table = spark.createDataFrame(table.collect(), table.schema)
    again = {r["version_id"]: r["split"] for r in splits.assign_splits(versions, source, targets, kept=table)[0].collect()}
    assert all(again[v] == got[v]["split"] for v in ("v1", "v4", "v5"))
    assert splits.split_conflicts(versions.limit(0), source).count() == 0


def test_proportions(spark):
    n = 3000
    versions = spark.range(n).selectExpr("concat('k', id) as document_key", "cast(null as string) as split", "concat('v', id) as version_id")
    source = spark.range(n).selectExpr("concat('k', id) as document_key", "concat('F', if(id % 3 = 0, 0, id)) as security_code", "cast(null as string) as company_name")
    targets = spark.createDataFrame([("a", 0.7), ("b", 0.15), ("c", 0.15)], "split string, proportion double")
    records, _ = splits.assign_splits(versions, source, targets)
    got = dict(records.groupBy("split").count().collect())
    assert abs(got["a"] / n - 0.7) < 0.01 and abs(got["b"] / n - 0.15) < 0.01
    assert records.where("group_code = 'F0'").select("split").distinct().count() == 1


# --- pieces ----------------------------------------------------------------------
@pytest.mark.parametrize("text", ["", "短", "甲乙丙。" * 900, "no boundary at all" * 200, "a" * 5000, ("A sentence here. " * 30 + "\n\n") * 12, "。" * 3000])
def test_pieces_round_trip(text):
    cut = pieces.cut_text(text)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    whole = text[: cut[0][1]]
    for (_a, b), (c, d) in zip(cut, cut[1:], strict=False):
        assert c <= b < d and 40 <= b - c <= 160
        whole += text[b:d]
    assert whole == text and all(b - a <= 1200 for a, b in cut)


def test_rechunk(spark):
    import json

    big = ("甲公司营业收入增长。" * 40 + "\n") * 5
    payload = lambda t: json.dumps({"text": t, "page_start": 1})
    rows = [("c0", "d", 0, payload("小")), ("c1", "d", 1, payload(big)), ("c1", "d", 1, payload(big)), ("c2", "d", 2, payload("末")), ("c3", "d", None, payload("无")), ("c4", None, 0, payload("")), ("c5", "d", 5, None), ("c6", "d", 6, "not json"), ("c7", "d", 7, "{}")]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, payload_json string").withColumn("text", F.lit("clash"))
    got = pieces.rechunk(df).orderBy("document_id", "chunk_index").collect()
    d = [r for r in got if r["document_id"] == "d"]
    assert [r["chunk_index"] for r in d] == list(range(len(d))) and d[0]["chunk_id"] == "c3" and d[-1]["chunk_id"] == "c2"
    assert all(r["document_length"] == len(r["piece_text"]) <= 1200 for r in got) and [r for r in got if r["chunk_id"] == "c4"][0]["piece_text"] == ""
    assert pieces.found(df).collect() == [("c1",)] and pieces.rechunk(df.limit(0)).count() == 0


# --- packing ---------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(6))
def test_packing_is_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 2049, 800) if seed % 2 else np.minimum(rng.lognormal(5.5, 1, 800).astype(int), 2048)
    container, used = packing.pack_sizes(sizes, 2048)
    fill = np.bincount(container, weights=sizes, minlength=used)
    assert (container >= 0).all() and fill.max() <= 2048 and used >= math.ceil(sizes.sum() / 2048)
    # never worse than best fit alone, and near the bound
    order = np.sort(sizes)[::-1]
    rooms: list[int] = []
    for s in order:
        fits = [r for r in range(len(rooms)) if rooms[r] >= s]
        if fits:
            rooms[min(fits, key=lambda r: rooms[r])] -= s
        else:
            rooms.append(2048 - s)
    assert used <= len(rooms) + 1


def test_pack_documents(spark):
    rows = [(i, "word " * n) for i, n in enumerate([10, 500, 3000, 0, 1500])] + [(9, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    got = packing.pack(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["container_id"], 0)
        by[r["container_id"]] += r["tokens"]
    assert max(by.values()) <= 2048
    for i, t in rows[:5]:
        parts = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["part_no"])
        assert sum(r["tokens"] for r in parts) == packing.count_tokens(t) and len(parts) == max(1, math.ceil(packing.count_tokens(t) / 2048))
    assert sum(r["doc_id"] == 9 for r in got) == 2 and packing.pack(df.limit(0)).count() == 0


# --- leaks -----------------------------------------------------------------------
def _english(rng, n):
    words = "revenue profit margin assets growth decline board review target supply contract region patents segment turnover customers equipment quarter outlook policy".split()
    return " ".join(rng.choice(words) + (f" {rng.randint(100, 9999)}" if rng.random() < 0.15 else "") for _ in range(n)) + "."


def test_leaks_against_planted_cases(spark):
    rng = random.Random(8)
    han = lambda n: "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(n))
    items = [(i, "en", _english(rng, 80)) for i in range(6)] + [(i, "zh", han(200)) for i in range(6, 12)] + [(20, None, None)]
    docs, want = [], set()
    for k in range(60):
        text = _english(rng, 60) + han(100)
        if k % 3 == 0:
            i, lang, t = items[k % 12]
            a = rng.randint(0, len(t) // 4)
            part = t[a : a + (330 if lang == "en" else 90)]
            if k % 2:
                part = part.upper() if lang == "en" else "\n".join(part[j : j + 9] for j in range(0, len(part), 9))
            else:
                part = part.replace(" growth ", " increase ", 1).replace(",", "，")
            text = text[:100] + part + text[100:]
            want.add((k, i))
        docs.append((k, text))
    short = items[7][2][:50]
    docs += [(100, "前文" + short + "后文"), (101, None), (102, ""), (103, LONG), (104, "x" + items[8][2]), (104, "x" + items[8][2])]
    want.add((104, 8))
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, lang string, text string")
    assert set(leaks.find_leaks(d, e).collect()) == want
    assert set(leaks.find_leaks(d, e, item_letters=700).collect()) == want
    assert leaks.find_leaks(d.limit(0), e).count() == 0 and leaks.find_leaks(d, e.limit(0)).count() == 0


def test_other_figures_are_no_leak(spark):
    item = "Closing revenue stood at RMB 123.45 or 17.2% of total assets compared with 998.7 a year earlier reflecting the ramp up of new lines and a board review of 55 contracts in the region, which the audit committee has noted."
    other = item.replace("123.45", "724.11").replace("17.2", "33.9").replace("998.7", "154.2").replace("55", "81")
    d = spark.createDataFrame([(1, item), (2, other)], "doc_id long, text string")
    e = spark.createDataFrame([(1, "en", item)], "item_id long, lang string, text string")
    assert leaks.find_leaks(d, e).collect() == [(1, 1)]


# --- truncation ------------------------------------------------------------------
def test_limits_are_found_and_judged(spark):
    rng = random.Random(2)
    whole = lambda n: "甲" * (n - 1) + "。"
    rows = []
    for i in range(600):
        n = int(rng.lognormvariate(5.6, 0.5)) + 5
        rows.append((i, whole(n) if n <= 400 else whole(n)[:400], "limited"))
        rows.append((1000 + i, whole(n), "free"))
    special = [(5000, None, "free"), (5001, "", None), (5002, " \n ", "free"), (5003, "甲公司收入增长…", None), (5004, "收入\t100.5\n成本\t20", "free"), (5005, "正文完。\n甲公司董事会\n2024年1月2日", "free"), (5006, "The board has revi", "free"), (5007, "关于甲公司项目进展的公告", "free"), (5008, LONG, "free"), (5009, whole(400), "limited")]
    df = spark.createDataFrame(rows + special + special[-1:], "doc_id long, text string, source string").withColumn("ending", F.lit("clash"))
    judged = truncation.judge(df)
    cut = {r["doc_id"] for r in truncation.cut_documents(judged).collect()}
    assert cut == {i for i, t, s in rows if len(t) == 400 and not t.endswith("。")} | {5003, 5006, 5008}
    shares = {r["source"]: r for r in truncation.cut_shares(judged).collect()}
    assert shares["limited"]["share"] > 0.1 and shares["free"]["share"] < 0.01 and shares[None]["cut"] == 1
    assert truncation.judge(df.limit(0)).count() == 0
    limits = truncation.source_limits(df.where("text <> '' and doc_id < 5000").select("source", F.char_length("text").alias("n_char"), F.octet_length("text").alias("n_byte"))).collect()
    assert {(r["source"], r["high"]) for r in limits if r["measure"] == "char"} == {("limited", 400)} and all(r["posterior"] > 0.9 for r in limits)


