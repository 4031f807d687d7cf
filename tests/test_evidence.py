from pyspark.sql import functions as F

from vellum.operators import evidence as E

BOX = "page int, box_id int, text string, box struct<x0:double,y0:double,x1:double,y1:double>"


def test_regions(spark):
    native = spark.createDataFrame([(1, 1, "收 入", (0.0, 0.0, 10.0, 10.0)), (1, 2, None, (50.0, 0.0, 60.0, 10.0))], BOX)
    seen = spark.createDataFrame([(1, 10, "收入", (90.0, 90.0, 99.0, 99.0)), (1, 11, "新", (1.0, 1.0, 9.0, 9.0)), (1, 12, "新", (0.0, 20.0, 10.0, 30.0)), (2, 13, "收入", (0.0, 0.0, 1.0, 1.0)), (1, 14, "", (52.0, 1.0, 58.0, 9.0))], BOX)
    got = [(r["page"], r["box_id"]) for r in E.merge_regions(native, seen, ["page"]).orderBy("page", "reading_order").collect()]
    assert got == [(1, 1), (1, 2), (1, 12), (2, 13)]
    assert E.merge_regions(native.limit(0), seen.limit(0), ["page"]).count() == 0
    b = seen.where("box_id = 10").select(E.clamp_box(F.col("box"), F.lit(95.0), F.lit(50.0))).first()[0]
    assert b is None


def test_nearest(spark):
    flat = "page int, box_id int, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0, 2.0), (1, 2, 500.0, 500.0, 502.0, 502.0), (2, 3, 0.0, 0.0, 2.0, 2.0)], flat)
    b = spark.createDataFrame([(1, 7, 0.0, 10.0, 2.0, 12.0), (1, 8, 0.0, 10.0, 2.0, 12.0), (1, 9, 0.0, 30.0, 2.0, 32.0)], flat)
    assert [tuple(r) for r in E.nearest_boxes(a, b, ["page"]).collect()] == [(1, 1, 7, 10.0)]


def test_claims(spark):
    rows = [("收入为105元", "收入为100元", "营业收入"), ("2024年收入100元", "2024年收入100元", "收入"), ("收入(100)元", "收入100元", "收入100元"), ("x", None, "x"), ("营业收入100元", "营业收入100元", "净利润")]
    df = spark.createDataFrame(rows, "c string, e string, k string").withColumn("r", E.claim_risks(F.col("c"), F.col("e"), F.col("k")))
    got = [(sorted(x["check"] for x in r["r"]), r["v"]) for r in df.select("r", E.verdict(F.col("r")).alias("v")).collect()]
    assert got[0] == (["missing_metric", "unsupported_number"], "reject") and got[1] == ([], "pass") and got[2] == (["sign_conflict"], "reject")
    assert got[3] == (["no_evidence"], "reject") and got[4] == (["missing_metric"], "review")


def test_targets_and_turns(spark):
    e = spark.createDataFrame([("c1", "t1"), ("c1", "t2"), ("c1", "t1"), (None, "t1"), ("c2", "t1")], "chunk_id string, target string")
    assert {(r["chunk_id"], tuple(r["targets"]), r["uses"]) for r in E.bind_targets(e).collect()} == {("c1", ("t1", "t2"), 3), ("c2", ("t1",), 1)}
    t = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "target string")
    assert {(r[0], r[1], r[2]) for r in E.sufficiency(t, e, 2).collect()} == {("t1", 2, True), ("t2", 1, False), ("t3", 0, False)}
    a, b = (spark.createDataFrame([("q", i) for i in x], "q string, i int") for x in ([1, 2, 3], [10]))
    assert [r["i"] for r in E.interleave(a, b, "q", ["i"]).orderBy("position").collect()] == [1, 10, 2, 3]
    used = E.judged_usage(spark.createDataFrame([("c", "q1")], "chunk_id string, query_id string"), spark.createDataFrame([("c", "q2")], "chunk_id string, query_id string")).first()
    assert used["gold_for"] == ["q1"] and used["negative_for"] == ["q2"]
    text = spark.createDataFrame([("q", 1, "ab"), ("q", 2, "cd"), ("q", 3, "e")], "q string, n int, t string")
    assert E.within_budget(text, "q", ["n"], "t", 4).count() == 2
