import datetime
import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.functions import finance, text
from vellum.operators import documents, evaluation, governance, regulated, retrieval, tables
from vellum.streaming import traces


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_tokens(spark):
    got = one(spark, "2024年营业收入 Revenue 100.5亿元", text.search_tokens)
    assert {"2024", "营业", "业收", "revenue", "100.5", "营业收入"} <= set(got) and "年" not in got
    assert one(spark, "", text.search_tokens) == [] and one(spark, "元", text.search_tokens) == ["元"]
    assert one(spark, "A&B's well-known 3.5", text.english_tokens) == ["a&b's", "well-known", "3.5"]
    assert one(spark, "营业收入 ab cd", text.token_estimate) == 7 and one(spark, "", text.token_estimate) == 1


def test_headings_and_keys(spark):
    assert [one(spark, s, text.heading_level) for s in ("第一章 总则", "二、财务", "（三）说明", "1.2 范围", "3、收入", "普通文字", "1,000 2,000", "二、这是一句。")] == [1, 2, 3, 4, 4, None, None, None]
    assert one(spark, " 第 12 页 ", text.repeated_key) == "第#页" and one(spark, "第 3 页/10", text.is_page_number)


def test_query_understanding(spark):
    assert [one(spark, q, finance.query_scope) for q in ("甲公司2024年分季度营业收入", "甲公司主营业务分产品收入", "甲公司2024年营业收入是多少", "天气")] == ["quarterly", "segment", "annual_summary", "unspecified"]
    assert one(spark, "天气", lambda c: finance.scope_budget(c, 30, 100)) == 30 and one(spark, "净利润", lambda c: finance.scope_budget(c, 30, 80)) == 80
    assert one(spark, "2025年经营目标是多少", finance.year_policy) == "forecast_target_no_report_filter"
    assert one(spark, "2024年年报中2025年的计划", finance.year_policy) == "explicit_report_and_forecast_target"
    assert one(spark, "2023年实际营业收入", finance.year_policy) == "fact_period_as_report_year"
    year = F.lit(2026)
    assert one(spark, "去年营收和前年净利润", lambda c: finance.resolve_relative(c, year)) == "2025年营收和2024年净利润"
    assert one(spark, "2022年报中去年的收入。去年呢", lambda c: finance.resolve_relative(c, year)) == "2022年报中2021年的收入。2025年呢"
    assert one(spark, "营收与毛利水平", text.expand_query) == "营业收入与毛利率"


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, page_start int, page_end int, section_path array<string>, text string, company string")


CHUNKS = [
    ("c0", "d", 0, 1, 1, [], "公司营业收入 100 亿元", "x"), ("c1", "d", 1, 2, 2, ["合并利润表"], "合并利润表 净利润", "x"), ("c2", "d", 2, 3, 3, [], "cash flow statement", "y"),
    ("c3", "d", 3, 4, 5, ["母公司利润表"], "其他", "y"), ("c4", "e", 0, 1, 1, None, None, None),
]


def brute_bm25(docs, query, tokens):
    import math

    n, avg = len(docs), sum(len(t) for t in tokens.values()) / len(docs)
    out = {}
    for q in query:
        df = sum(q in t for t in tokens.values())
        for d, t in tokens.items():
            tf = t.count(q)
            if tf:
                out[d] = out.get(d, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
    return out


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    words = ["cash", "flow", "营业", "收入", "profit", "loss", "assets"]
    rows = [(f"c{i:02}", " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(40)] + [("c40", None), ("c41", "")]
    docs = spark.createDataFrame(rows, "chunk_id string, text string")
    queries = spark.createDataFrame([("q1", "cash flow cash"), ("q2", "营业收入"), ("q3", "absent"), ("q4", None)], "query_id string, query string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.bm25(queries, docs.where("text is not null"), F.col("text"), k=100).collect()}
    lists = {r[0]: r[1] for r in docs.where("text is not null").select("chunk_id", text.search_tokens(F.col("text"))).collect()}
    for q, terms in (("q1", ["cash", "flow", "cash"]), ("q2", ["营业", "业收", "收入", "营业收入"])):
        want = brute_bm25(lists, terms, lists)
        assert {k: round(v, 4) for (x, k), v in got.items() if x == q} == {k: round(v, 4) for k, v in want.items()}
    assert not any(x == "q3" for x, _ in got)
    assert retrieval.bm25(queries.limit(0), docs, F.col("text")).count() == 0 and retrieval.bm25(queries, docs.limit(0), F.col("text")).count() == 0


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_shuffles_no_pairs(spark):
    docs = spark.range(3000).select(F.format_string("c%04d", "id").alias("chunk_id"), F.concat_ws(" ", F.lit("cash flow profit"), "id").alias("text"))
    queries = spark.range(60).select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lit("cash flow profit"), F.col("id") + 7).alias("query"))
    before = shuffled_rows(spark)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.bm25(queries, docs, F.col("text"), k=3).collect()}
    want = {q: [f"c{q + 7:04}", *[f"c{i:04}" for i in range(4) if i != q + 7]][:3] for q in range(60)}
    assert got == {(q, i + 1): c for q, cs in want.items() for i, c in enumerate(cs)}
    assert shuffled_rows(spark) - before < 60 * 3000 / 4


@pytest.mark.parametrize("bound", [1, 7, 1000])
def test_bm25_blocks_agree(bound, monkeypatch):
    """Blocks of any size keep the best chunks, and of equal ones the first by id."""
    rng = random.Random(5)
    version = lambda i: {"kept": i % 9 > 0, "h": i, "length": rng.randint(5, 7), "ids": (ids := sorted(rng.sample(range(4), rng.randint(0, 4)))), "tfs": [rng.randint(1, 2) for _ in ids]}
    rows = [{"chunk_id": f"c{i:03}" if i else None, "versions": [version(i), *[version(500 + i)] * (i % 5 == 0)]} for i in range(120)]
    rng.shuffle(rows)
    kind = pa.schema({"chunk_id": pa.string(), "versions": pa.list_(pa.struct({"kept": pa.bool_(), "h": pa.int64(), "length": pa.int32(), "ids": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32())}))})
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 10], kind) for i in range(0, 120, 10)]
    idf, queries = np.array([0.5, 1.0, 2.0, 3.0]), [[(0, 1), (2, 2)], [(1, 1)], [(3, 1), (0, 1), (1, 3)], []]
    monkeypatch.setattr(retrieval, "BLOCK_CHUNKS", bound)
    sent = SimpleNamespace(value=(["p", "q", None, "s"], pa.string(), queries)), SimpleNamespace(value=(idf, 6.0))
    got = [(r["query_id"], r["chunk_id"], r["near"]) for b in retrieval._best_chunks(iter(batches), *sent, 10) for r in b.to_pylist()]
    want = []
    for name, terms in zip(["p", "q", None, "s"], queries):
        scores = []
        for r in rows:
            groups = {}
            for v in r["versions"]:
                for t, tf in zip(v["ids"], v["tfs"]):
                    groups[v["kept"], v["length"], t] = groups.get((v["kept"], v["length"], t), 0) + tf
            raw = sum(qtf * idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 6)) for q, qtf in terms for (kept, n, t), tf in groups.items() if kept and t == q)
            scores += [(-round(raw, 9), r["chunk_id"] is None, r["chunk_id"])] if raw else []
        want += [(name, c, pytest.approx(-s, abs=2e-9)) for s, _, c in sorted(scores)[:10]]
    assert got == want


def test_bm25_blocks_of_queries(spark, monkeypatch):
    docs = spark.range(50).select(F.format_string("c%02d", "id").alias("chunk_id"), F.concat_ws(" ", F.lit("cash"), F.col("id") % 7).alias("text"))
    queries = spark.range(10).select("id", F.concat_ws(" ", F.lit("cash"), "id").alias("query"))
    run = lambda: sorted(map(tuple, retrieval.bm25(queries, docs, F.col("text"), query_key="id", k=4).collect()))
    whole = run()
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 3)
    assert len(whole) == 40 and run() == whole


def test_bm25_versions_of_a_chunk(spark):
    rows = [("a", "x", "cash flow"), ("a", "x", "cash flow"), ("a", "x", "cash profit"), ("a", "y", "cash loss loss"), ("b", "x", "loss"), (None, "x", "loss")]
    docs = spark.createDataFrame(rows, "chunk_id string, company string, text string")
    queries = spark.createDataFrame([("q", "cash loss")], "query_id string, query string")
    lists = {0: ["cash", "flow"], 1: ["cash", "profit"], 2: ["cash", "loss", "loss"], 3: ["loss"], 4: ["loss"]}
    avg, idf = sum(map(len, lists.values())) / 5, lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    part = lambda df, tf, length: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))
    # the two versions of "a" of two tokens are one document: "cash" twice; the third adds to its score
    want = {"a": part(2, 2, 2) + part(2, 1, 3) + part(3, 2, 3), "b": part(3, 1, 1), None: part(3, 1, 1)}
    got = [(r["chunk_id"], r["score"]) for r in retrieval.bm25(queries, docs, F.col("text")).orderBy("rank").collect()]
    assert [c for c, _ in got] == ["a", "b", None] and all(abs(s - want[c]) < 1e-6 for c, s in got)


def test_filters_do_not_move_statistics(spark):
    docs = _chunks(spark, CHUNKS[:3])
    queries = spark.createDataFrame([("q", "营业收入")], "query_id string, query string")
    full = {r["chunk_id"]: r["score"] for r in retrieval.bm25(queries, docs, F.col("text")).collect()}
    kept = {r["chunk_id"]: r["score"] for r in retrieval.bm25(queries, docs, F.col("text"), keep=F.col("company") == "x").collect()}
    assert kept == {k: v for k, v in full.items() if k in kept} and "c0" in kept


def test_fusion_and_ties(spark):
    r = spark.createDataFrame([("q", "b", 1, None), ("q", "a", None, 1), ("q", "c", 2, 2), ("q", "d", None, None)], "query_id string, chunk_id string, lexical_rank int, dense_rank int")
    got = [x["chunk_id"] for x in retrieval.rank_fusion(r, weights={"lexical_rank": 2.0, "dense_rank": 1.0}).orderBy("rank").collect()]
    assert got == ["c", "b", "a", "d"]


def test_nearest_vectors_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(60, None), (61, [0.0] * 5)], "vec_id long, embedding array<double>")
    got = retrieval.nearest_vectors(df, df.where("vec_id in (3, 10)"), k=4, block=1).orderBy("query_id", "rank").collect()
    n = v / np.linalg.norm(v, axis=1)[:, None]
    for q in (3, 10):
        s = np.round(n @ n[q], 9)
        want = sorted(range(60), key=lambda i: (-s[i], i))[:4]
        assert [r["vec_id"] for r in got if r["query_id"] == q] == want


def test_windows_and_scopes(spark):
    c = _chunks(spark, CHUNKS)
    got = retrieval.page_windows(c.where("chunk_id = 'c1'"), c, most=2).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == ["c0", "c1"]
    scopes = {r[0]: r[1] for r in retrieval.statement_scopes(c).collect()}
    assert scopes == {"c0": "unspecified", "c1": "consolidated", "c2": "consolidated", "c3": "parent", "c4": "unspecified"}


def fold_units(tokens, heads, b):
    """Packing one unit at a time, as brute force."""
    groups, now, fresh = [], [], False
    for i, n in enumerate(tokens):
        size = sum(tokens[k] for k in now)
        if fresh and ((heads[i] and size >= b.least) or size + n > b.most or size >= b.target):
            groups.append((now[0], i))
            tail = []
            for k in reversed(now):
                if heads[i] or heads[k] or sum(tokens[j] for j in [k, *tail]) > b.overlap:
                    break
                tail.insert(0, k)
            now = tail if sum(tokens[k] for k in tail) + n <= b.most else []
        now.append(i)
        fresh = True
    return groups + ([(now[0], len(tokens))] if now else [])


def test_packing_equals_the_fold():
    budget, rng = documents.Budget(target=10, most=15, least=4, overlap=3), np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(0, 30))
        tokens, heads = rng.integers(1, 9, n), rng.random(n) < 0.2
        spans = documents.pack_spans(tokens, heads, budget)
        assert spans == fold_units(tokens.tolist(), heads.tolist(), budget)
        assert sorted({i for a, b in spans for i in range(a, b)}) == list(range(n))


def test_section_stack(spark):
    u = spark.createDataFrame([("d", i, t) for i, t in enumerate(["第一章 甲", "二、乙", "正文", "第二章 丙", "正文"])], "document_id string, unit_no int, unit string")
    assert [r["section"] for r in documents.section_stack(u).orderBy("unit_no").collect()] == ["第一章 甲", "第一章 甲 > 二、乙", "第一章 甲 > 二、乙", "第二章 丙", "第二章 丙"]


def test_extractors(spark):
    texts = [
        ("q", "第一季度 （1-3月份） 第二季度 第三季度 第四季度 营业收入 1,000.5 2,000 3,000 4,000 归属于上市公司股东的净利润 1 2 3 -4"), ("u", "第一季度 第二季度 第三季度 第四季度 营业收入 1 2"),
        ("n", "营业收入和营业成本 本期发生额 上期发生额 收入 成本 主营业务 10 8 9 7 合计 10 8 9 7"), ("s", "主营业务分产品情况 分产品 营业收入 营业成本 毛利率 酒类 100 40 60.0 1.5 2.5 3.5"),
        ("a", "主要会计数据 2024年 2023年 本期比上年同期增减(%) 2022年 营业收入 100 90 11.1 80"), ("c", "前五名客户销售额 1,234.5 万元，占年度销售总额 12.3%"), ("x", None), ("e", ""), ("l", "第一季度" * 50_000),
    ]
    df = spark.createDataFrame(texts, "id string, text string").withColumn("cells", F.lit("clash"))
    got = {}
    for r in regulated.extract_tables(df, "id", "text").orderBy("cell_no").collect():
        got.setdefault((r["key"], r["table_kind"]), []).append((r["row_label"], r["column_label"], r["cell_value"], r["section"]))
    assert set(got) == {("q", "quarterly"), ("n", "note_cost"), ("s", "segment"), ("a", "annual_data"), ("c", "concentration")}
    q = got["q", "quarterly"]
    assert len(q) == 8 and q[0] == ("营业收入", "第一季度", "1000.5", "") and q[-1][2] == "-4"
    assert got["n", "note_cost"][0] == ("主营业务", "本期收入", "10", "") and len(got["n", "note_cost"]) == 8
    assert got["s", "segment"][0] == ("酒类", "营业收入", "100", "主营业务分产品情况")
    assert [c[1:3] for c in got["a", "annual_data"]] == [("2024年", "100"), ("2023年", "90"), ("2022年", "80")]
    assert [c[2] for c in got["c", "concentration"]] == ["1234.5", "12.3"]
    assert regulated.extract_tables(df.limit(0), "id", "text").count() == 0


def test_cells(spark):
    c = spark.createDataFrame([("t", "b", 1), ("t", "a", 2), ("t", "b", 3), ("t", None, 0)], "table_id string, row_label string, n int")
    assert {(r[1], r[2]) for r in tables.first_appearance_index(c, "table_id", "row_label", "n").collect()} == {("b", 1), ("a", 2)}
    left = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "k string")
    right = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 3)], "k string, v int")
    assert dict(tables.attach_unique(left, right, ["k"], ["v"]).collect()) == {"k1": 1, "k2": None, "k3": None}
    boxes = spark.createDataFrame([("p", i, 0.0, y0, 1.0, y1) for i, (y0, y1) in enumerate([(0.0, 5.0), (4.0, 8.0), (7.0, 9.0), (10.0, 12.0)])], "page string, box_id int, x0 double, y0 double, x1 double, y1 double")
    assert [r["band"] for r in tables.row_bands(boxes, ["page"]).orderBy("box_id").collect()] == [1, 1, 1, 2]
    assert tables.column_clusters([1, 2, 3, 50, 51, 200], 10) == [0, 0, 0, 1, 1, 2]
    turned = boxes.limit(1).select(tables.rotate_box(F.struct("x0", "y0", "x1", "y1"), F.lit(100.0), F.lit(200.0), F.lit(90))).first()[0]
    assert tuple(turned) == (195.0, 0.0, 200.0, 1.0)


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", None, True), ("b", "x", None)], "s string, t string, ok boolean")
    got = {(r["dimension"], r["stratum"]): (r["cases"], r["rate"]) for r in evaluation.stratified(rows, ["s", "t"], F.col("ok")).collect()}
    assert got[("overall", "all")] == (3, 0.666667) and got[("s", "a")] == (2, 0.5) and got[("t", "(none)")] == (1, 1.0)
    w = spark.range(1).select(evaluation.wilson(F.lit(4), F.lit(21))).first()[0]
    assert (round(w["low"], 3), round(w["high"], 3)) == (0.077, 0.4)
    values = spark.createDataFrame([("c1", 1.0), ("c1", 0.0), ("c2", 1.0), ("c3", None)], "c string, v double")
    b = evaluation.clustered_bootstrap(values, "c", "v", samples=200).first()
    assert b["clusters"] == 2 and b["low"] <= 2 / 3 <= b["high"]
    run = lambda *x: spark.createDataFrame(list(x), "q string, ok boolean")
    c = dict(evaluation.compare_runs(run(("1", True), ("2", False)), run(("1", False), ("2", True), ("3", True)), "q", "ok").collect())
    assert c == {"regressed": 1, "fixed": 1, "unpaired": 1}


def test_governance(spark):
    t = datetime.datetime(2024, 1, 1)
    v = spark.createDataFrame([("v1", "d", "active", t), ("v2", "d", "staging", t + datetime.timedelta(1)), ("v3", "d", "failed", t + datetime.timedelta(2))], "version_id string, document_key string, status string, created_at timestamp")
    assert {r[0]: r[2] for r in governance.activate_latest(v).collect()} == {"v1": "superseded", "v2": "active", "v3": "failed"}
    reg = spark.createDataFrame([("d", "h1", "active"), ("d", "h2", "staging"), ("d", "h3", "superseded")], "document_key string, content_sha256 string, status string")
    cand = spark.createDataFrame([("d", "h1"), ("d", "h2"), ("d", "h3"), ("d", "h4")], "document_key string, content_sha256 string")
    assert {r[1]: r[2] for r in governance.registration(cand, reg).collect()} == {"h1": "unchanged", "h2": "resume", "h3": "reuse", "h4": "new"}
    assert one(spark, "600519+600887+600519+ ", governance.composite_ids) == ["600519", "600887"]
    with pytest.raises(Exception, match="no key"):
        governance.require(cand, F.col("content_sha256") == "h4", "no key").collect()


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = traces.read_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    q = traces.windowed_metrics(stream, late="1000 days").writeStream.outputMode("complete").format("memory").queryName("metrics").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("metrics").select("kind", "n", "total").collect()}
    assert got == {tuple(r) for r in traces.windowed_metrics(events).select("kind", "n", "total").collect()}
    steps = spark.createDataFrame([(1, "running", 1), (1, "completed", 2), (2, "completed", 1)], "job_id long, state string, at int")
    steps.write.mode("overwrite").parquet(str(tmp_path / "jobs"))
    jobs = traces.read_stream(spark, str(tmp_path / "jobs"), "job_id long, state string, at int")
    q = traces.job_states(jobs).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["job_id"], r["state"], r["refused"]) for r in spark.table("jobs").collect()} == {(1, "completed", 0), (2, "queued", 1)}


def test_core_runs_without_the_text_package():
    import pathlib

    import vellum

    for p in pathlib.Path(vellum.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "vellum.llm" not in p.read_text()
