"""Queries of answers and their checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import answers as A
from vellum.runtime import table


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_cases").where("query is not null").groupBy(F.col("case_id").alias("query_id")).agg(F.min("query").alias("query"))


def _h(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_hits").distinct().where("query_id is not null and text is not null")


def metric_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).select("query_id", F.array_join(A.metric_mentions(F.col("query")), ",").alias("metrics"))


def amounts(spark: SparkSession, d: str) -> DataFrame:
    a = A.amounts(F.col("text"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", a.alias("a")).where(F.size("a") > 0)
    return rows.select("doc_id", F.size("a").alias("amounts"), F.array_max("a").cast("double").alias("largest"), F.array_min("a").cast("double").alias("smallest"))


def clarifications(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).select("query_id", A.needs_clarification(F.col("query")).alias("unclear"))


def support(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the number of their hits, and of those that speak of the same year and metrics."""
    keyed = _h(spark, d).join(_q(spark, d), "query_id").withColumn("report_year", F.split_part("document_key", F.lit(":"), F.lit(4)).try_cast("int"))
    return keyed.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(A.supports(F.col("query"), F.col("text"), F.col("report_year"))).alias("supporting"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    return A.citations(_h(spark, d))


def values_found(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose first acceptable value stands in one of the hits of their case."""
    facts = table(spark, d, "agent_cases").distinct().select(F.col("case_id").alias("query_id"), F.explode("expected_facts").alias("f")).select("query_id", F.col("f.fact_id").alias("fact_id"), F.get("f.acceptable_values", F.lit(0)).alias("value")).where("value is not null")
    j = facts.join(_h(spark, d).select("query_id", "text"), "query_id")
    return j.groupBy("query_id", "fact_id").agg(F.max(A.value_found(F.col("text"), F.col("value")).cast("int")).alias("found"))


def signed_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = A.signed_numbers(F.col("text"))
    return table(spark, d, "eval_passages").select("item_id", F.array_join(n, " ").alias("numbers"))


def period_growth(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cell_proofs").distinct().where("table_id is not null and row_label is not null")
    return A.growth(c, ["table_id", "row_label"], "column_label", "cell_value", "本期金额", "上期金额")


def claim_similarity(spark: SparkSession, d: str) -> DataFrame:
    q = _h(spark, d).where("hit_rank = 1").groupBy("query_id").agg(F.min("text").alias("text"))
    return q.join(_q(spark, d), "query_id").select("query_id", F.round(A.similarity(F.col("query"), F.col("text")), 6).alias("similarity"))


QUERIES = {f"a_{f.__name__}": f for f in (metric_mentions, amounts, clarifications, support, citations, values_found, signed_numbers, period_growth, claim_similarity)}

_Q = "q AS (SELECT case_id AS query_id, min(query) AS query FROM agent_cases WHERE query IS NOT NULL GROUP BY 1)"
_H = "h AS (SELECT DISTINCT * FROM search_hits WHERE query_id IS NOT NULL AND text IS NOT NULL)"
_M = "|".join(sorted(A.CANONICAL, key=len, reverse=True))
_MAP = "MAP {" + ", ".join(f"'{n}': '{m}'" for n, m in A.CANONICAL.items()) + "}"
_re = lambda words: "|".join(words)
_ok = "(y = '' OR coalesce(CAST(report_year AS VARCHAR) = y, false) OR contains(text, y))" + "".join(f" AND (NOT contains(query, '{k}') OR regexp_matches(text, '{_re(v)}'))" for k, v in A.SUPPORT.items())
_sq = r"regexp_replace({}, '[ ,，\t\r\n]+', '', 'g')"
SQL = {
    "a_metric_mentions": f"WITH {_Q}, m AS (SELECT query_id, list_transform(regexp_extract_all(query, '({_M})', 1), lambda n: {_MAP}[n]) AS m FROM q) SELECT query_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS metrics FROM m",
    "a_amounts": f"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '{A.AMOUNT}', 1)) AS n, unnest(regexp_extract_all(text, '{A.AMOUNT}', 2)) AS u FROM documents WHERE text IS NOT NULL),
      v AS (SELECT doc_id, CAST(replace(n, ',', '') AS DECIMAL(20, 4)) * CASE u {" ".join(f"WHEN '{k}' THEN {v}" for k, v in A.AMOUNT_FACTORS.items())} END AS v FROM n) SELECT doc_id, count(*) AS amounts, CAST(max(v) AS DOUBLE) AS largest, CAST(min(v) AS DOUBLE) AS smallest FROM v GROUP BY 1""",
    "a_clarifications": f"WITH {_Q}, t AS (SELECT query_id, regexp_replace(query, '[ \\t\\r\\n]+', '', 'g') AS t FROM q) SELECT query_id, CASE WHEN contains(t, '成本') AND NOT regexp_matches(t, '{_re(A.COST_SCOPES)}') THEN 'cost' WHEN contains(t, '利润') AND NOT regexp_matches(t, '{_re(A.PROFIT_SCOPES)}') THEN 'profit' END AS unclear FROM t",
    "a_support": f"""WITH {_Q}, {_H}, j AS (SELECT h.query_id, text, query, TRY_CAST(split_part(document_key, ':', 4) AS INT) AS report_year, regexp_extract(query, '20[0-9]{{2}}') AS y FROM h JOIN q ON q.query_id = h.query_id) SELECT query_id, count(*) AS hits, count_if({_ok}) AS supporting FROM j GROUP BY 1""",
    "a_citations": f"WITH {_H} SELECT query_id, ordinal, chunk_id, substr(text, 1, 1800) AS excerpt FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, chunk_id) AS INT) AS ordinal FROM h) WHERE ordinal <= 5",
    "a_values_found": f"""WITH {_H}, e AS (SELECT case_id AS query_id, unnest(expected_facts) AS f FROM (SELECT DISTINCT * FROM agent_cases)), v AS (SELECT query_id, f.fact_id AS fact_id, {_sq.format('f.acceptable_values[1]')} AS v FROM e WHERE f.acceptable_values[1] IS NOT NULL), j AS (SELECT v.query_id, fact_id, v, {_sq.format('text')} AS t FROM v JOIN h ON h.query_id = v.query_id)
      SELECT query_id, fact_id, max(CAST(CASE WHEN regexp_matches(v, '^-?[0-9]+(?:\\.[0-9]+)?%?$') THEN regexp_matches(t, '(?:^|[^0-9.])' || replace(replace(v, '.', '[.]'), '-', '[-]') || CASE WHEN suffix(v, '%') THEN '' ELSE '(?:[^0-9]|$)' END) ELSE contains(t, v) AND v <> '' END AS INT)) AS found FROM j GROUP BY 1, 2""",
    "a_signed_numbers": r"""WITH x AS (SELECT item_id, list_transform(regexp_extract_all(regexp_replace(text, '[(（]([0-9][0-9,]*(?:\.[0-9]+)?%?)[)）]', '-\1', 'g'), '-?[0-9][0-9,]*(?:\.[0-9]+)?%?'), lambda x: replace(x, ',', '')) AS n FROM eval_passages) SELECT item_id, array_to_string(list_filter(n, lambda x: NOT regexp_matches(x, '^-?(?:19[0-9][0-9]|20[0-9][0-9]|2100)$')), ' ') AS numbers FROM x""",
    "a_period_growth": """WITH p AS (SELECT DISTINCT * FROM cell_proofs WHERE table_id IS NOT NULL AND row_label IS NOT NULL), v AS (SELECT *, CASE WHEN regexp_matches(replace(cell_value, ',', ''), '^ *[-+]?[0-9]+([.][0-9]*)?([eE][0-9]+)? *$') THEN TRY_CAST(replace(cell_value, ',', '') AS DECIMAL(20, 4)) END AS v FROM p), g AS (SELECT table_id, row_label, min(v) FILTER (column_label = '本期金额') AS now, min(v) FILTER (column_label = '上期金额') AS before FROM v GROUP BY 1, 2)
      SELECT table_id, row_label, now, before, now - before AS difference, round(CASE WHEN before <> 0 THEN (CAST(now AS DOUBLE) - CAST(before AS DOUBLE)) / CAST(before AS DOUBLE) * 100 END, 4) AS growth_percent FROM g WHERE now IS NOT NULL AND before IS NOT NULL""",
}
