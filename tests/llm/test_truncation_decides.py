import random

from pyspark.sql import functions as F

from vellum.llm import truncation


def _documents(spark):
    """A source of headlines without full stops and a limit of 60 characters: only the lengths tell what is cut."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        n = max(8, int(rng.lognormvariate(3.7, 0.45)))
        rows.append((i, ("甲" * n)[:60], "headlines", n > 60))
    rows += [(2000 + i, "甲" * rng.randint(20, 200) + "。", "reports", False) for i in range(500)]
    rows += [(3000 + i, "甲" * rng.randint(20, 200), "reports", True) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, truth boolean")


def test_posterior_and_rates_decide(spark):
    docs = _documents(spark)
    truth = {r["doc_id"] for r in docs.where("truth").collect()}
    judged = truncation.judge(docs)
    found = {r["doc_id"] for r in truncation.cut_documents(judged).collect()}
    assert len(found & truth) >= 0.97 * len(truth) and len(found & truth) >= 0.9 * len(found)
    # every text of the source ends alike, so without the posterior nothing of it is found
    assert {r["ending"] for r in judged.where("source = 'headlines'").select("ending").distinct().collect()} == {"open"}
    flat = judged.where("source = 'headlines'").select(F.count_if((F.col("posterior") == 0) & F.col("cut")), F.count_if((F.col("posterior") > 0) & F.col("cut"))).first()
    assert flat[0] == 0 and flat[1] > 50


def test_same_on_repeated_data(spark):
    """The answer for a text does not change when all data come again under new ids."""
    docs = _documents(spark).drop("truth")
    once = {r["doc_id"] for r in truncation.cut_documents(truncation.judge(docs)).collect()}
    again = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    assert {r["doc_id"] for r in truncation.cut_documents(truncation.judge(again)).collect()} == once | {i + 10_000 for i in once}


def test_long_last_lines_and_blanks(spark):
    rows = [(1, "甲" * 20_000 + "。" + " \n　" * 500, "s"), (2, "甲" * 20_000 + "…" + "\t" * 700, "s"), (3, " " * 3000, "s"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["ending"], r["cut"]) for r in truncation.judge(df).collect()}
    assert got == {1: ("whole", False), 2: ("torn", True), 3: (None, False), 4: (None, False)}
