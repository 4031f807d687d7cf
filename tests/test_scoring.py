from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vellum.functions import finance
from vellum.operators import answers, evaluation, geometry, scoring, tabular
from vellum.plans.geometry import DRAWN


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expression(F.col("v"))).collect()]


def test_sets_and_lanes(spark):
    a = spark.createDataFrame([("t1", "x"), ("t1", "y"), ("t1", "y"), ("t2", None)], "g string, k string")
    b = spark.createDataFrame([("t1", "x"), ("t3", "z")], "g string, k string")
    got = {r["g"]: (r["expected"], r["found"], r["shared"], r["f1"]) for r in scoring.set_agreement(a, b, "g", ["k"]).collect()}
    assert got == {"t1": (2, 1, 1, 0.666667), "t2": (1, 0, 0, 0.0), "t3": (0, 1, 0, 0.0), "(all)": (3, 2, 1, 0.4)}
    empty = scoring.set_agreement(a.limit(0), b.limit(0), "g", ["k"]).collect()
    assert [(r["g"], r["expected"], r["f1"]) for r in empty] == [("(all)", 0, 0.0)]
    p = spark.createDataFrame([("native", True, True), ("native", False, False), (None, True, None)], "lane string, ok boolean, tried boolean")
    rates = {r["lane"]: (r["cases"], r["ok"]) for r in scoring.lane_rates(p, "lane", {"ok": F.col("ok")}, {"ok": F.coalesce("tried", F.lit(False))}).collect()}
    assert rates == {"native": (2, 1.0), "(none)": (1, None)}


def test_coverage_and_bindings(spark):
    f = spark.createDataFrame([("c", "f1", "1,234.5"), ("c", "f1", "x"), ("c", "f2", "9"), ("d", "f1", "7")], "case_id string, fact_id string, value string")
    h = spark.createDataFrame([("c", 1, "共 1 234.5 元，另有 77"), ("c", 2, None), ("e", 3, "7")], "case_id string, hit_id long, text string")
    assert {tuple(r) for r in scoring.fact_coverage(f, h.where("text is not null")).collect()} == {("c", 2, 1, 0.5), ("d", 1, 0, 0.0)}
    bound = scoring.bind_by_numbers(f.select("case_id", "fact_id", F.col("value").alias("text")), spark.createDataFrame([("c", 1, "1,234.5 和 9"), ("c", 2, "9")], "case_id string, hit_id long, text string"), "case_id", "fact_id", "hit_id", most=1)
    assert {(r["fact_id"], r["hit_id"]) for r in bound.collect()} == {("f1", 1), ("f2", 1)}


def test_scalar_rules(spark):
    assert column(spark, ["D:20240102030405+08'00'", "2024", "20240229", "x", None, ""], scoring.pdf_time)[3:] == [None, None, None]
    assert [t.strftime("%Y%m%d%H%M%S") for t in column(spark, ["D:20240102030405+08'00'", "2024", "20240229"], scoring.pdf_time)] == ["20240101190405", "20240101000000", "20240229000000"]
    assert column(spark, ["收入19元", "无数", None, "a9"], scoring.mutate_number) == ["收入10元", "无数", None, "a0"]
    assert column(spark, ["短，很长的一句，中句", "一句", None], scoring.drop_longest_clause) == ["短，中句", "一句", None]
    assert column(spark, ["2023年初", "2023 本年末", "上年末", None], scoring.period_label) == ["2023期初", "2023 期末".replace(" ", ""), "期初", None]
    assert column(spark, [Decimal("1234.565"), Decimal("-2"), None], scoring.money, "decimal(12,4)") == ["1,234.56", "-2.00", None]
    two = spark.createDataFrame([("共1 2,34元", "1234"), ("5.0", "5.0"), ("无", "7"), ("5", "")], "t string, v string")
    assert [r[0] for r in two.select(scoring.value_span(F.col("t"), F.col("v"))).collect()] == [2, 1, 0, 0]
    assert column(spark, ["营业收入和研发投入占营业收入比例及总资产、个人客户"], answers.metric_mentions) == [["营业收入", "研发投入强度", "资产总额", "个人客户数"]]
    q = spark.createDataFrame([("净利润与毛利率", "毛 利率为5"), ("毛利率", None)], "q string, t string")
    assert [r[0] for r in q.select(answers.missing_metrics(answers.metric_mentions(F.col("q")), F.col("t"))).collect()] == [["净利润"], ["毛利率"]]
    s = spark.createDataFrame([("第一季度合计", ["quarterly", "annual_data"]), ("毛利率", None)], "q string, k array<string>")
    assert [r[0] for r in s.select(finance.structured_score(F.col("q"), F.col("k"))).collect()] == [36, 0]


def test_company_mentions(spark):
    q = spark.createDataFrame([("a", "比较甲乙股份与丙丁"), ("b", "甲乙"), ("c", None), ("d", "")], "query_id string, query string")
    n = spark.createDataFrame([("甲乙股份",), ("甲乙",), ("丙丁",), (None,), ("",), ("丙丁",)], "company string")
    assert {tuple(r) for r in scoring.company_mentions(q, n).collect()} == {("a", "甲乙股份", 3), ("a", "甲乙", 3), ("a", "丙丁", 8), ("b", "甲乙", 1)}
    assert scoring.company_mentions(q, n.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_percentiles_equal_sorting(spark, n):
    import random

    rng = random.Random(n)
    rows = [(g, rng.choice([1.5, 2.0, rng.random() * 9])) for g in ("a", "b") for _ in range(n)] + [("a", None)]
    got = {r["g"]: r for r in evaluation.nearest_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in ("a", "b"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert (got[g]["n"], got[g]["p50"], got[g]["p95"], got[g]["largest"]) == (n, v[round((n - 1) * 0.5)], v[round((n - 1) * 0.95)], v[-1])


def test_plans(spark):
    q = spark.createDataFrame([("s", "甲2023年合并与母公司口径"), ("r", "甲2024年年报中2023年调整前与调整后"), ("c", "甲与乙2022年和2023年毛利率"), ("n", "甲的毛利率"), ("w", "甲" + "、".join(f"20{y}年" for y in range(10, 25)))], "query_id string, query string")
    m = spark.createDataFrame([(k, c, p) for k, cs in (("s", "甲"), ("r", "甲"), ("c", "甲乙"), ("n", "甲"), ("w", "甲")) for p, c in enumerate(cs)], "query_id string, company string, position int")
    got = {}
    for r in tabular.comparison_targets(q, m).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["company"], r["fact_year"], r["document_year"], r["scope"], r["version"], r["clarification"]))
    assert [x[3] for x in got["s"]] == ["consolidated", "parent"] and [x[1:3] + x[4:5] for x in got["r"]] == [(2023, 2024, "as_reported"), (2023, 2024, "restated")]
    assert [x[:2] for x in got["c"]] == [("甲", 2022), ("甲", 2023), ("乙", 2022), ("乙", 2023)] and got["n"][0][5] == "objects" and got["w"][0][5] == "budget"


def test_answers_of_tables(spark):
    c = spark.createDataFrame([("k", "收入", "第一季度", "1", 0), ("k", "收入", "第二季度", "2", 1), ("k", "收入", "第三季度", "3", 2), ("k", "收入", "第四季度", "-1", 3), ("k", "利润", "第一季度", "1", 4), ("j", "收入", "第一季度", "x", 0)], "key string, row_label string, column_label string, cell_value string, cell_no int")
    a = spark.createDataFrame([("k", "收入", "6")], "key string, row_label string, value string")
    got = tabular.quarter_totals(c, a, "key").collect()
    assert len(got) == 1 and float(got[0]["total"]) == 5 and float(got[0]["difference"]) == -1 and not got[0]["agrees"]
    pairs = tabular.pair_differences(spark.createDataFrame([("g", "a", 1.0), ("g", "b", 3.0), ("h", "a", 1.0)], "g string, i string, v double"), ["g"], "i", "v").collect()
    assert [(r["g"], r["higher"], r["lower"], float(r["difference"])) for r in pairs] == [("g", "b", "a", 2.0)]


def test_geometry(spark):
    s = spark.createDataFrame([(1, "合计 1,234.5 (12)", 0.0, 150.0), (2, "2024年", 0.0, 9.0), (3, None, 0.0, 1.0), (4, "，", 0.0, 1.0), (5, "", 0.0, 1.0)], "box_id long, text string, x0 double, x1 double")
    got = {(r["box_id"], r["text"], r["numeric"]) for r in geometry.split_spans(s).collect()}
    assert got == {(1, "合计", False), (1, "1,234.5", True), (1, "12", True), (2, "2024年", False)}
    t = spark.createDataFrame(DRAWN, "line int, box_id int, text string, x0 double, x1 double").withColumn("height", F.lit(10.0))
    joined = {(r["line"], r["text"]) for r in geometry.join_fragments(t, ["line"]).collect()}
    assert {(1, "360,403"), (1, "2024"), (1, "12"), (2, "1.5"), (2, ","), (3, "7"), (3, ","), (3, "123")} <= joined
    rows = geometry.centre_rows(spark.createDataFrame([("p", i, 0.0 + i, y, y + 10.0) for i, y in enumerate([0.0, 3.0, 20.0, 21.0])], "page string, box_id int, x0 double, y0 double, y1 double"), ["page"])
    assert [r["row_no"] for r in rows.orderBy("box_id").collect()] == [0, 0, 1, 1]
    n = spark.createDataFrame([("p", 1, 1, 10.0), ("p", 1, 2, 52.0), ("p", 1, 3, 49.0)], "page string, line int, box_id int, x double")
    h = spark.createDataFrame([("p", "b", 50.0), ("p", "a", 12.0), ("p", "c", 51.0), ("p", "d", 99.0)], "page string, column_label string, x double")
    assert {(r["column_label"], r["box_id"]) for r in geometry.assign_columns(n, h, ["page", "line"]).collect()} == {("a", 1), ("b", 3), ("c", 2)}
    assert column(spark, ["总资产 5 股 本 7 总资产"], lambda c: geometry.label_segments(c, ["总资产", "股本"])) == [[("总资产", "5"), ("股本", "7"), ("总资产", "")]]
