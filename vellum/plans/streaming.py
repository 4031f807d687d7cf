"""Batch forms of the streaming queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.runtime import table
from vellum.streaming import traces


def windowed_metrics(spark: SparkSession, d: str) -> DataFrame:
    return traces.windowed_metrics(table(spark, d, "events")).selectExpr("cast(window_start as timestamp_ntz) as window_start", "kind", "n", "total", "largest")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return traces.sessions(table(spark, d, "events")).selectExpr("user", "cast(session_start as timestamp_ntz) as session_start", "cast(session_end as timestamp_ntz) as session_end", "n")


QUERIES = {"s_windowed_metrics": windowed_metrics, "s_sessions": sessions}
SQL = {
    "s_windowed_metrics": "SELECT date_trunc('hour', ts) AS window_start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1, 2",
    "s_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id AS "user", min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM n GROUP BY user_id, k""",
}
