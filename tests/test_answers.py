from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vellum.operators import answers as A
from vellum.sources import files


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_metrics_and_amounts(spark):
    assert one(spark, "归属于上市公司股东的净利润与净利润、营业收入", A.metric_mentions) == ["归母净利润", "净利润", "营业收入"]
    assert one(spark, "收入1,234.5万元，成本-2亿元", A.amounts) == [Decimal(12345000), Decimal(-200000000)]
    assert one(spark, "", A.amounts) == [] and one(spark, None, A.amounts) is None
    assert one(spark, "成本是多少", A.needs_clarification) == "cost" and one(spark, "营业成本是多少", A.needs_clarification) is None
    assert one(spark, "亏损(1,200)，2024年增长5%", A.signed_numbers) == ["-1200", "5%"]


def test_citations(spark):
    answer = "收入为100元[1][2]。无引用。成本为5元[3]；"
    got = one(spark, answer, A.claim_citations)
    assert [(r["claim"], r["ordinals"]) for r in got] == [("收入为100元", [1, 2]), ("成本为5元", [3])]
    assert one(spark, answer, lambda c: A.unresolved(c, F.array(F.lit(1), F.lit(2)))) == [3]
    assert one(spark, "无", lambda c: A.unresolved(c, F.array(F.lit(1)))) is None


@pytest.mark.parametrize("text,value,found", [("为 1,234.5 元", "1234.5", True), ("为 11234.5 元", "1234.5", False), ("为 1234.56", "1234.5", False), ("增长 5%", "5%", True), ("15%", "5%", False), ("扩大", "扩大", True), ("", "5", False)])
def test_values(spark, text, value, found):
    assert one(spark, text, lambda c: A.value_found(c, F.lit(value))) is found


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(A.similarity("a", "b")).collect()] == [0.75, None]


def test_calculation():
    c = A.Calculation()
    evidence = {"c1": "营业收入 1,200.50 元", "c2": "营业收入 1000 元，毛利率 12%，上年 10%"}
    c.operand("now", "1,200.50", "c1", evidence)
    c.operand("before", "1000", "c2", evidence)
    c.operand("m1", "12%", "c2", evidence)
    c.operand("m0", "10%", "c2", evidence)
    c.step("difference", "subtract", ["now", "before"], "元")
    c.step("growth", "growth_percent", ["now", "before"], "%")
    c.step("points", "subtract", ["m1", "m0"])
    assert (c.render("difference"), c.render("growth"), c.render("points", 0)) == ("200.50元", "20.05%", "2个百分点")
    assert c.sources["growth"] == ["c1", "c2"] and not c.errors
    c.operand("x", "77", "c1", evidence)
    c.operand("y", "1", "c9", evidence)
    c.step("z", "ratio_percent", ["now", "nowhere"])
    c.step("now", "add", ["before"])
    assert len(c.errors) == 4


def test_json_lines_fail_closed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    files.write_json_lines(df, str(tmp_path / "out"))
    assert files.read_json_lines(spark, str(tmp_path / "out"), "id long, t string").count() == 2
    with pytest.raises(Exception, match="exist"):
        files.write_json_lines(df, str(tmp_path / "out"))
    (tmp_path / "bad.json").write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "bad.json"), "id long").collect()


def test_generations(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "k")
    root = str(tmp_path / "index")
    files.publish({"terms": df}, root, "g1")
    files.publish({"terms": df.limit(1)}, root, "g2")
    assert files.current(spark, root)["terms"].count() == 1
    for bad in ("../g3", ".g"):
        with pytest.raises(ValueError):
            files.publish({"terms": df}, root, bad)
    a, b = files.content_hash(df, ["k"]).first(), files.content_hash(df.orderBy(F.desc("k")), ["k"]).first()
    assert a == b and a["rows"] == 3 and files.content_hash(df.limit(2), ["k"]).first() != a
    vectors = spark.createDataFrame([(0, [1.0])], "k long, v array<double>")
    assert {(r["k"], r["reused"]) for r in files.incremental(df, vectors, "k", ["v"]).collect()} == {(0, True), (1, False), (2, False)}


def test_filings(spark):
    rows = spark.createDataFrame([("甲2024年年度报告", "甲"), ("甲2024年年度报告摘要", "甲"), ("甲乙股份2023年度报告", "甲")], "title string, security_name string")
    assert files.select_annual_report(rows, "甲", 2024).count() == 1 and files.select_annual_report(rows, "甲", 2023).first()["title"] == "甲乙股份2023年度报告"
    for year, data in ((2020, rows), (2024, rows.union(rows))):
        with pytest.raises(Exception, match="annual report"):
            files.select_annual_report(data, "甲", year).collect()
    assert one(spark, "<em>甲</em>&amp;乙 ", files.plain_title) == "甲&乙"


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"no pdf")
    assert files.read_pdf_pages(spark, str(tmp_path)).first()["error"] == "not a PDF file"
    base = spark.createDataFrame([(1, "a"), (2, "b")], "page int, t string")
    assert set(files.replace_pages(base, spark.createDataFrame([(2, "c")], "page int, t string"), ["page"]).collect()) == {(1, "a"), (2, "c")}
