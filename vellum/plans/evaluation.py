"""Queries of evaluation and governance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import evaluation as E
from vellum.operators import governance as G
from vellum.runtime import table

DIMENSIONS = ["split", "task_type", "source", "expected_behavior"]
SPLITS = ["calibration", "dev", "frozen_test"]


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_cases").distinct()


def _answered(spark: SparkSession, d: str) -> DataFrame:
    """Cases with whether one of their evidence pages is among the stored hits."""
    hits = table(spark, d, "search_hits").where("query_id is not null and document_key is not null").select(F.col("query_id").alias("case_id"), "document_key").distinct()
    gold = _cases(spark, d).select("case_id", F.explode("evidence_sources").alias("e")).select("case_id", F.col("e.document_key").alias("document_key")).distinct()
    ok = hits.join(gold, ["case_id", "document_key"], "left_semi").select("case_id").distinct().withColumn("found", F.lit(True))
    searched = hits.select("case_id").distinct()
    return _cases(spark, d).join(searched, "case_id").join(ok, "case_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def stratified_report(spark: SparkSession, d: str) -> DataFrame:
    return E.stratified(_answered(spark, d), DIMENSIONS, F.col("found"))


def challenge_rates(spark: SparkSession, d: str) -> DataFrame:
    return E.multi_label_rates(_answered(spark, d), "challenge_types", F.col("found"))


def macro_scores(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").distinct().where("query_id is not null and score is not null")
    m = E.macro_mean(h.join(_cases(spark, d).select(F.col("case_id").alias("query_id"), "task_type"), "query_id"), "query_id", "task_type", "score")
    return m.select("task_type", F.round("macro_mean", 6).alias("macro_mean"), "groups")


def event_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return E.nearest_percentiles(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


def metric_coverage(spark: SparkSession, d: str) -> DataFrame:
    return E.coverage(table(spark, d, "search_hits").distinct(), ["score", "lexical_rank", "dense_rank"])


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    rows = _answered(spark, d).select(F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce("evidence_sources", F.array()), lambda e: e["document_key"]))), ",").alias("cluster"), F.col("found").cast("double").alias("v"))
    return E.clustered_bootstrap(rows, "cluster", "v")


def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "search_hits").distinct().where("query_id is not null")
    run = lambda c: h.where(F.col(c).isNotNull()).groupBy("query_id").agg((F.min(c) <= 2).alias("ok"))
    return E.compare_runs(run("lexical_rank"), run("dense_rank"), "query_id", "ok")


def document_overlaps(spark: SparkSession, d: str) -> DataFrame:
    e = _cases(spark, d).select("case_id", "split", F.explode("evidence_sources").alias("e")).select("case_id", "split", F.col("e.document_key").alias("unit"))
    o = G.split_overlaps(e, "unit", "split", "case_id")
    return o.select("unit_id", F.array_join("splits", ",").alias("splits"), F.array_join("query_ids", ",").alias("query_ids"))


def issuer_overlaps(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_manifest").distinct()
    o = G.split_overlaps(s, "security_code", "split", "document_key")
    return o.select("unit_id", F.array_join("splits", ",").alias("splits"), F.size("query_ids").alias("documents"))


def key_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = G.composite_ids(F.col("document_key"), ":")
    return table(spark, d, "source_manifest").select("document_key", F.posexplode(parts).alias("position", "part")).distinct()


def quotas(spark: SparkSession, d: str) -> DataFrame:
    return G.quota_report(table(spark, d, "source_manifest").distinct(), "split", SPLITS, "report_year", "question_target")


def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return G.reconcile(table(spark, d, "source_manifest").distinct(), table(spark, d, "version_manifest").distinct())


def registrations(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "version_manifest").distinct()
    s = table(spark, d, "source_manifest").select("document_key", F.col("sha256").alias("content_sha256")).distinct()
    return G.registration(s, v)


def activations(spark: SparkSession, d: str) -> DataFrame:
    return G.activate_latest(table(spark, d, "version_manifest").distinct())


def histories(spark: SparkSession, d: str) -> DataFrame:
    return G.version_history(table(spark, d, "version_manifest").distinct())


def index_audit(spark: SparkSession, d: str) -> DataFrame:
    """Integrity of the hits against chunks and cases: kinds of fault and how many rows have them."""
    h = table(spark, d, "search_hits").distinct()
    c = table(spark, d, "chunks").select("chunk_id").distinct().withColumn("known_chunk", F.lit(True))
    q = table(spark, d, "agent_cases").select(F.col("case_id").alias("query_id")).distinct().withColumn("known_query", F.lit(True))
    j = h.join(c, "chunk_id", "left").join(q, "query_id", "left")
    faults = F.array_compact(F.array(F.when(F.col("known_chunk").isNull(), "unknown_chunk"), F.when(F.col("query_id").isNull(), "no_query"), F.when(F.col("query_id").isNotNull() & F.col("known_query").isNull(), "unknown_query"), F.when(F.coalesce(F.col("hit_rank") < 1, F.lit(True)), "bad_rank"), F.when(F.col("retrieved_at").isNull(), "no_time")))
    return j.select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count("*").alias("rows"))


def fact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a case, how many have a number among their values, and how many a unit."""
    f = _cases(spark, d).select("case_id", F.explode("expected_facts").alias("f"))
    g = f.groupBy("case_id").agg(F.count("*").alias("facts"), F.count_if(F.coalesce(F.exists("f.acceptable_values", lambda v: v.rlike("[0-9]")), F.lit(False))).alias("with_number"), F.count_if(F.coalesce(F.col("f.unit") != "", F.lit(False))).alias("with_unit"))
    return g


QUERIES = {f"e_{f.__name__}": f for f in (stratified_report, challenge_rates, macro_scores, event_percentiles, metric_coverage, bootstrap_interval, run_comparison, document_overlaps, issuer_overlaps, key_parts, quotas, reconciliation, registrations, activations, histories, index_audit, fact_counts)}

_A = """a AS (SELECT DISTINCT * FROM agent_cases), hq AS (SELECT DISTINCT query_id AS case_id, document_key FROM search_hits WHERE query_id IS NOT NULL AND document_key IS NOT NULL),
  ge AS (SELECT case_id, unnest(evidence_sources) AS e FROM a), ok AS (SELECT DISTINCT hq.case_id FROM hq JOIN ge ON ge.case_id = hq.case_id AND ge.e.document_key = hq.document_key),
  s AS (SELECT a.*, a.case_id IN (SELECT case_id FROM ok) AS found FROM a WHERE a.case_id IN (SELECT case_id FROM hq))"""
_z = E.Z95
_W = f"round(greatest((p + {_z * _z} / (2 * n) - {_z} * sqrt(p * (1 - p) / n + {_z * _z} / (4 * n * n))) / (1 + {_z * _z} / n), 0), 6) AS low, round(least((p + {_z * _z} / (2 * n) + {_z} * sqrt(p * (1 - p) / n + {_z * _z} / (4 * n * n))) / (1 + {_z * _z} / n), 1), 6) AS high"
_pct = lambda p: f"vs[CAST(round_even((n - 1) * {p}, 0) AS INT) + 1]"
SQL = {
    "e_stratified_report": f"""WITH {_A}, r AS ({" UNION ALL ".join(f"SELECT '{x}' AS dimension, coalesce({x}, '(none)') AS stratum, found FROM s" for x in DIMENSIONS)} UNION ALL SELECT 'overall', 'all', found FROM s),
      g AS (SELECT dimension, stratum, count(*) AS cases, count_if(found) AS successes, count_if(found) / count(*) AS p, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1, 2) SELECT dimension, stratum, cases, successes, round(p, 6) AS rate, {_W} FROM g""",
    "e_challenge_rates": f"WITH {_A}, r AS (SELECT unnest(list_distinct(challenge_types)) AS label, found FROM s) SELECT label, count(*) AS cases, count_if(found) AS successes, round(avg(CAST(found AS INT)), 6) AS rate FROM r WHERE label IS NOT NULL GROUP BY 1",
    "e_macro_scores": "WITH a AS (SELECT DISTINCT case_id, task_type FROM (SELECT DISTINCT * FROM agent_cases)), h AS (SELECT DISTINCT * FROM search_hits), m AS (SELECT task_type, h.query_id, avg(score) AS m FROM h JOIN (SELECT case_id, task_type FROM (SELECT DISTINCT * FROM agent_cases)) a ON a.case_id = h.query_id WHERE score IS NOT NULL GROUP BY 1, 2) SELECT task_type, round(avg(m), 6) AS macro_mean, count(*) AS groups FROM m GROUP BY 1",
    "e_event_percentiles": f"WITH g AS (SELECT event_type, list_sort(list(value)) AS vs, count(*) AS n, max(value) AS largest FROM events GROUP BY 1) SELECT event_type, n, {_pct(0.5)} AS p50, {_pct(0.95)} AS p95, largest FROM g",
    "e_metric_coverage": "WITH h AS (SELECT DISTINCT * FROM search_hits), u AS (SELECT 'score' AS metric, score AS v FROM h UNION ALL SELECT 'lexical_rank', lexical_rank FROM h UNION ALL SELECT 'dense_rank', dense_rank FROM h) SELECT metric, round(avg(v), 6) AS mean, round(count(v) / count(*), 6) AS covered FROM u GROUP BY 1",
    "e_run_comparison": """WITH h AS (SELECT DISTINCT * FROM search_hits WHERE query_id IS NOT NULL), l AS (SELECT query_id, min(lexical_rank) <= 2 AS x FROM h WHERE lexical_rank IS NOT NULL GROUP BY 1), n AS (SELECT query_id, min(dense_rank) <= 2 AS y FROM h WHERE dense_rank IS NOT NULL GROUP BY 1)
      SELECT CASE WHEN x IS NULL OR y IS NULL THEN 'unpaired' WHEN NOT x AND y THEN 'fixed' WHEN x AND NOT y THEN 'regressed' WHEN x THEN 'both' ELSE 'neither' END AS change, count(*) AS cases FROM l FULL JOIN n ON l.query_id = n.query_id GROUP BY 1""",
    "e_document_overlaps": "WITH a AS (SELECT DISTINCT * FROM agent_cases), u AS (SELECT case_id, split, unnest(evidence_sources).document_key AS unit FROM a), g AS (SELECT unit AS unit_id, list_sort(list(DISTINCT split)) AS s, list_sort(list(DISTINCT case_id)) AS q FROM u WHERE unit IS NOT NULL AND split IS NOT NULL GROUP BY 1) SELECT unit_id, array_to_string(s, ',') AS splits, array_to_string(q, ',') AS query_ids FROM g WHERE len(s) > 1",
    "e_issuer_overlaps": "WITH g AS (SELECT security_code AS unit_id, list_sort(list(DISTINCT split)) AS s, count(DISTINCT document_key) AS documents FROM source_manifest WHERE security_code IS NOT NULL AND split IS NOT NULL GROUP BY 1) SELECT unit_id, array_to_string(s, ',') AS splits, documents FROM g WHERE len(s) > 1",
    "e_key_parts": "WITH k AS (SELECT DISTINCT document_key, string_split(document_key, ':') AS parts FROM source_manifest), d AS (SELECT document_key, list_filter(parts, lambda x, i: trim(x) <> '' AND list_position(parts, x) = i) AS parts FROM k) SELECT document_key, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS position, trim(unnest(parts)) AS part FROM d",
    "e_quotas": "WITH s AS (SELECT DISTINCT * FROM source_manifest), g AS (SELECT report_year, " + ", ".join(f"count_if(split = '{x}') AS {x}_n, CAST(coalesce(sum(question_target) FILTER (split = '{x}'), 0) AS BIGINT) AS {x}_target" for x in SPLITS) + " FROM s GROUP BY 1) SELECT *, " + ", ".join(f"greatest({x}_target - {x}_n, 0) AS {x}_left" for x in SPLITS) + " FROM g",
    "e_reconciliation": """WITH a AS (SELECT document_key, min(split) AS a, count(*) AS na FROM (SELECT DISTINCT * FROM source_manifest) GROUP BY 1), b AS (SELECT document_key, min(split) AS b1, max(split) AS b2, count(*) AS nb FROM (SELECT DISTINCT * FROM version_manifest) GROUP BY 1),
      j AS (SELECT coalesce(a.document_key, b.document_key) AS document_key, CASE WHEN na IS NULL THEN 'not_planned' WHEN nb IS NULL THEN 'missing_version' WHEN b1 <> b2 THEN 'split_disagrees_within' WHEN coalesce(a.a, '') <> coalesce(b1, '') THEN 'split_differs' END AS issue FROM a FULL JOIN b ON a.document_key = b.document_key) SELECT * FROM j WHERE issue IS NOT NULL""",
    "e_registrations": """WITH v AS (SELECT DISTINCT * FROM version_manifest), s AS (SELECT DISTINCT document_key, sha256 AS content_sha256 FROM source_manifest), k AS (SELECT document_key, content_sha256, max(CAST(status = 'active' AS INT)) AS active, max(CAST(status IN ('staging', 'failed') AS INT)) AS open FROM v GROUP BY 1, 2)
      SELECT s.document_key, s.content_sha256, CASE WHEN active IS NULL THEN 'new' WHEN active = 1 THEN 'unchanged' WHEN open = 1 THEN 'resume' ELSE 'reuse' END AS action FROM s LEFT JOIN k ON k.document_key = s.document_key AND k.content_sha256 = s.content_sha256""",
    "e_activations": """WITH v AS (SELECT DISTINCT * FROM version_manifest), r AS (SELECT *, status IN ('active', 'superseded', 'staging') AS live FROM v)
      SELECT version_id, document_key, CASE WHEN live THEN CASE WHEN row_number() OVER (PARTITION BY document_key, live ORDER BY created_at DESC NULLS LAST, version_id DESC) = 1 THEN 'active' ELSE 'superseded' END ELSE status END AS status FROM r""",
    "e_histories": "WITH v AS (SELECT DISTINCT * FROM version_manifest) SELECT document_key, version_id, CAST(row_number() OVER w AS INT) AS position, lag(version_id) OVER w AS previous FROM v WINDOW w AS (PARTITION BY document_key ORDER BY created_at NULLS FIRST, version_id)",
    "e_index_audit": """WITH h AS (SELECT DISTINCT * FROM search_hits), f AS (SELECT unnest(list_filter([CASE WHEN chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) THEN 'unknown_chunk' END, CASE WHEN query_id IS NULL THEN 'no_query' END, CASE WHEN query_id IS NOT NULL AND query_id NOT IN (SELECT case_id FROM agent_cases WHERE case_id IS NOT NULL) THEN 'unknown_query' END,
      CASE WHEN coalesce(hit_rank < 1, true) THEN 'bad_rank' END, CASE WHEN retrieved_at IS NULL THEN 'no_time' END], lambda x: x IS NOT NULL)) AS fault FROM h) SELECT fault, count(*) AS "rows" FROM f GROUP BY 1""",
    "e_fact_counts": "WITH f AS (SELECT case_id, unnest(expected_facts) AS f FROM (SELECT DISTINCT * FROM agent_cases)) SELECT case_id, count(*) AS facts, count_if(coalesce(len(list_filter(f.acceptable_values, lambda v: regexp_matches(v, '[0-9]'))) > 0, false)) AS with_number, count_if(coalesce(f.unit <> '', false)) AS with_unit FROM f GROUP BY 1",
}
