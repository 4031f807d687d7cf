"""Operators and queries do the whole job, where they once did a part of it."""

import difflib

import duckdb
from pyspark.sql import functions as F

from vellum.operators import evaluation, retrieval
from vellum.plans import answers as answer_plans
from vellum.plans import evaluation as evaluation_plans
from vellum.plans import evidence as evidence_plans
from vellum.plans import retrieval as retrieval_plans

DATA = "/root/testdata/sf0.01"


def oracle(sql):
    """Rows of a statement over the tables of the data set."""
    c = duckdb.connect()
    for t in ("agent_cases", "chunks", "search_hits"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return sorted(c.execute(sql).fetchall())


def test_bootstrap_draws_every_cluster(spark):
    many, samples = 5000, 20
    rows = spark.range(2 * many).select(F.format_string("k%05d", F.col("id") % many).alias("c"), (F.col("id") % 7).cast("double").alias("v"))
    got = evaluation.clustered_bootstrap(rows, "c", "v", samples=samples).first()
    sums = [r["v"] % 7 + (r["v"] + many) % 7 for r in spark.range(many).select(F.col("id").alias("v")).collect()]
    draws = spark.range(samples).select("id", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("draw")).select("id", F.pmod(F.xxhash64(F.lit(0), "id", "draw"), F.lit(many)).alias("place")).toPandas()
    means = sorted(draws["place"].map(sums.__getitem__).groupby(draws["id"]).mean() / 2)
    assert got["clusters"] == many and abs(got["low"] - means[0]) < 1e-9 and abs(got["high"] - means[18]) < 1e-9


def test_page_windows_take_every_hit(spark):
    sql = retrieval_plans.SQL["r_page_windows"]
    some = sql.replace("SELECT DISTINCT chunk_id AS anchor_id FROM h)", f"SELECT DISTINCT chunk_id AS anchor_id FROM h WHERE hit_id % {retrieval_plans.EVERY} = 0)")
    got = sorted(tuple(r) for r in retrieval_plans.page_windows(spark, DATA).collect())
    assert some != sql and got == oracle(sql) and len(got) > len(oracle(some))


def test_page_windows_meet_once_over_many_buckets(spark):
    rows = [("a", "d", 0, 5, 40), ("b", "d", 1, 1, 60), ("c", "d", 2, 41, 41), ("x", "d", 3, 43, 50), ("n", "d", 4, None, 9), ("o", "e", 0, 5, 40)]
    c = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, page_start int, page_end int")
    got = retrieval.page_windows(c.where("chunk_id = 'a'"), c).orderBy("position").collect()
    assert [(r["chunk_id"], r["position"]) for r in got] == [("a", 1), ("b", 2), ("c", 3)]


def test_claim_similarity_compares_whole_texts(spark):
    pairs = oracle("""SELECT q.query_id, query, text FROM (SELECT case_id AS query_id, min(query) AS query FROM agent_cases WHERE query IS NOT NULL GROUP BY 1) q
      JOIN (SELECT query_id, min(text) AS text FROM search_hits WHERE hit_rank = 1 AND query_id IS NOT NULL AND text IS NOT NULL GROUP BY 1) h ON h.query_id = q.query_id""")
    want = {i: round(difflib.SequenceMatcher(None, q, t, autojunk=False).ratio(), 6) for i, q, t in pairs}
    assert any(len(t) > 200 for _, _, t in pairs)
    assert dict(answer_plans.claim_similarity(spark, DATA).collect()) == want


def test_claim_checks_read_whole_texts(spark):
    sql = evidence_plans.SQL["v_claim_checks"]
    short = sql.replace("t AS c, e", "substr(t, 1, 200) AS c, e")
    got = sorted(tuple(r) for r in evidence_plans.claim_checks(spark, DATA).collect())
    assert short != sql and got == oracle(sql) and got != oracle(short)


def test_bootstrap_query_takes_the_default_samples(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(evaluation, "clustered_bootstrap", lambda *a, **k: asked.append(k))
    evaluation_plans.bootstrap_interval(spark, DATA)
    assert asked == [{}]


def test_bm25_asks_every_question(spark):
    sql = retrieval_plans.SQL["r_bm25_top10"]
    some = sql.replace(retrieval_plans._Q, retrieval_plans._SOME_Q)
    got = sorted(tuple(r) for r in retrieval_plans.bm25_top10(spark, DATA).collect())
    whole = oracle(sql)
    assert some != sql and len(got) > 40 * len(oracle(some))
    assert [(q, c, rank) for q, c, _, rank in got] == [(q, c, rank) for q, c, _, rank in whole] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, whole))
