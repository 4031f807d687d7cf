"""Streams of traces and jobs: windowed metrics with late rows, and the life of jobs as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, *, time: str = "ts", kind: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n, total, largest) of tumbling windows; works on a stream and on a table alike.

    On a stream rows later than `late` behind the newest are left out, and a window's row
    comes once it can't change any more.
    """
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__t", late)
    g = timed.groupBy(F.window("__t", window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.max(value).alias("largest"))
    return g.select(F.col("w.start").alias("window_start"), "kind", "n", "total", "largest")


def sessions(events: DataFrame, *, time: str = "ts", user: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """(user, session_start, session_end, n): runs of a user's rows with no gap longer than `gap`."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__t", gap)
    g = timed.groupBy(F.session_window("__t", gap).alias("w"), F.col(user).alias("user")).agg(F.count("*").alias("n"), F.max("__t").alias("last"))
    return g.select("user", F.col("w.start").alias("session_start"), F.col("last").alias("session_end"), "n")


JOB_STATES = {"queued": {"running"}, "running": {"completed", "failed", "queued"}, "completed": set(), "failed": {"queued"}}


def job_states(steps: DataFrame) -> DataFrame:
    """(job_id, state, changes, refused): the state of each job after a stream of (job_id, state, at) steps.

    A step that the state before doesn't allow is refused and counted.  Custom state, so
    it runs on streams only.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, changes, refused = state.get if state.exists else ("queued", 0, 0)
        for step in pd.concat(list(batches)).sort_values("at")["state"]:
            if step in JOB_STATES.get(now, set()):
                now, changes = step, changes + 1
            elif step != now:
                refused += 1
        state.update((now, changes, refused))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "changes": [changes], "refused": [refused]})

    out = "job_id long, state string, changes int, refused int"
    return steps.groupBy("job_id").applyInPandasWithState(fold, out, "now string, changes int, refused int", "update", "NoTimeout")


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Traces appended as parquet files under a folder."""
    return spark.readStream.schema(schema).parquet(path)
