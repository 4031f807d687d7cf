import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import overlaps

_names = random.Random(1)
COMPANIES = ["".join(_names.sample("灏薇蓁纺榆翊渊骁禾曦泓筠暄砺湜缇峤岚", 3)) + "股份" for _ in range(160)] + ["".join(_names.sample(["tul", "kav", "ron", "mip", "zen", "bri", "ola", "emu"], 3)).title() + " Foods" for _ in range(120)]
METRICS = {
    "zh": ["营业收入", "净利润", "存货余额", "应收账款", "管理费用", "商誉", "固定资产", "在建工程", "长期借款", "毛利率", "合同负债", "分红总额", "研发费用", "订单金额"],
    "en": ["net profit", "goodwill", "gross margin", "fixed assets", "trade receivables", "inventories", "selling expenses", "order intake", "dividend payout", "finance costs", "contract liabilities", "overseas revenue"],
}


def ask(company, metric, years):
    if company[0].isascii():
        return f"State the {metric} of {company} for {years[0]} and {years[1]} and subtract the former."
    return f"列出{company}{years[0]}年、{years[1]}年的{metric}，再给出两者之差。"


def light(rng, q):
    """A light edit: the question stays the same."""
    zh = ["谢谢", "请问"]
    edits = [lambda s: s.upper(), lambda s: s.replace("20", "２０"), lambda s: s.rstrip(".。"), lambda s: (f"Please: {s}" if s[0].isascii() else f"你好，{s}"), lambda s: s.replace("给出", "列示"), lambda s: s.replace("年的", "年"), lambda s: (s if s[0].isascii() else s + rng.choice(zh))]
    for e in rng.sample(edits, rng.randint(1, 3)):
        q = e(q)
    return q


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(2500):
        c = rng.choice(COMPANIES)
        m, y = rng.choice(METRICS["en" if c[0].isascii() else "zh"]), sorted(rng.sample(range(2014, 2026), 2))
        rows.append((f"c{i:04}", "calibration", ask(c, m, y)))
        if rng.random() < 0.25:
            rows.append((f"d{i:04}", rng.choice(["dev", "frozen_test"]), light(rng, ask(c, m, y))))
            want.add((c, m, tuple(y)))
        if rng.random() < 0.2:  # another measure, company or year
            rows.append((f"x{i:04}", "dev", ask(c, rng.choice(METRICS["en" if c[0].isascii() else "zh"]), [y[0], y[1] + 1])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "clash") for r in rows], "case_id string, split string, query string, source string, canon string")


def pairs_of(spark, rows, **options):
    canon = overlaps.canonical_cases(frame(spark, rows), ["calibration"], ["dev", "frozen_test"], **options)
    return set(map(tuple, overlaps.overlapping_pairs(overlaps.cross_split_pairs(canon)).collect()))


def truth(rows):
    """What the questions ask for decides: brute force over all pairs."""
    import re

    def what(q):
        q = q.replace("２０", "20").lower()
        q = re.sub(r"please: |你好，|谢谢|请问", "", q).replace("列示", "给出").replace("年的", "年")
        return re.sub(r"[\W_]", "", q)

    left, right = {}, {}
    for i, s, q in rows:
        (left if s == "calibration" else right).setdefault(what(q), set()).add(i)
    return {tuple(sorted((a, b))) for k in left for a in left[k] for b in right.get(k, ())}


def test_light_edits_are_learnt(spark, corpus):
    got, want = pairs_of(spark, corpus), truth(corpus)
    assert len(want) > 150 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.97 * len(got)
    assert len(pairs_of(spark, corpus, rounds=0) & want) < len(got & want)


def test_order_and_content_are_kept(spark, corpus):
    """Questions that ask for something else never pair, however alike the words."""
    a = "What is the ratio of revenue to cost at {} in 2019?"
    b = "What is the ratio of cost to revenue at {} in 2019?"
    more = [(f"z{i}{s}", split, q.format(c)) for i, c in enumerate(COMPANIES[-20:]) for s, split, q in (("a", "calibration", a), ("b", "dev", b))]
    more += [("y1", "calibration", "Alpha net profit against Beta revenue in 2020"), ("y2", "dev", "Beta net profit against Alpha revenue in 2020"), ("y3", "calibration", "甲公司2019年净利润"), ("y4", "dev", "甲公司2020年净利润")]
    got = pairs_of(spark, corpus + more)
    assert not {p for p in got if p[0][0] in "yz" or p[1][0] in "yz"}


def test_units_counts_and_dirty_rows(spark):
    base = "列出某某建材2021年、2022年的资本开支，再给出两者之差。"
    rows = [("a", "calibration", base), ("b", "dev", base.replace("2021", "２０２１") + " "), ("c", "dev", base.replace("资本开支", "营业收入")), ("e", "frozen_test", base), ("h", "dev", None), ("i", None, base), ("j", "calibration", ""), ("k", "dev", "长" * 300_000), ("a", "calibration", base), (None, "dev", base)]
    canon = overlaps.canonical_cases(frame(spark, rows), ["calibration"], ["dev", "frozen_test"])
    assert pairs_of(spark, rows) == {("a", "b"), ("a", "e")}
    assert [(r["splits"], r["query_ids"]) for r in overlaps.overlap_units(canon).collect()] == [(["calibration", "dev", "frozen_test"], ["a", "b", "e"])]
    assert {tuple(r) for r in overlaps.overlap_counts(canon).collect()} == {("dev", "s", 1, 1), ("frozen_test", "s", 1, 1)}
    assert pairs_of(spark, []) == set()


def test_counts_equal_listed_pairs(spark, corpus):
    canon = overlaps.canonical_cases(frame(spark, corpus), ["calibration"], ["dev", "frozen_test"])
    pairs = overlaps.cross_split_pairs(canon)
    listed = {tuple(r) for r in pairs.groupBy("eval_split", "eval_source").agg(F.countDistinct("eval_id"), F.count("*")).collect()}
    assert {tuple(r) for r in overlaps.overlap_counts(canon).collect()} == listed


def test_large_units_are_parted(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "UNIT_IDS", 10)
    rows = [(f"c{i}", "calibration" if i % 2 else "dev", "net profit of Abc in 2020?") for i in range(100)]
    units = overlaps.overlap_units(overlaps.canonical_cases(frame(spark, rows), ["calibration"], ["dev"])).collect()
    assert len(units) > 4 and sorted(i for u in units for i in u["query_ids"]) == sorted(r[0] for r in rows) and all(u["splits"] == ["calibration", "dev"] for u in units)


def test_one_letter():
    for a, b, same in (("difference", "diference", True), ("percentage", "percentge", True), ("average", "avergae", True), ("assets", "assess", True), ("assets", "profit", False), ("assets", "asset", True)):
        assert overlaps._one_letter_apart(a, b) == same
