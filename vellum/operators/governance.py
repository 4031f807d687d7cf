"""Governance of benchmarks and the registry of document versions: leaks, coverage, quotas, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_overlaps(rows: DataFrame, unit: str, split: str, query: str) -> DataFrame:
    """(unit_id, splits, query_ids): units that stand in more than one split."""
    g = rows.where(F.col(unit).isNotNull() & F.col(split).isNotNull()).groupBy(F.col(unit).alias("unit_id")).agg(F.sort_array(F.collect_set(split)).alias("splits"), F.sort_array(F.collect_set(query)).alias("query_ids"))
    return g.where(F.size("splits") > 1)


def composite_ids(value: Column, separator: str = "[+]") -> Column:
    """The parts of a composite id, in order, each once, without blanks around them."""
    return F.array_distinct(F.filter(F.transform(F.split(value, separator), lambda x: F.trim(x)), lambda x: x != ""))


def quota_report(rows: DataFrame, split: str, splits: list[str], group: str, target: str) -> DataFrame:
    """One row a group: rows and target by split, and what is left to the target."""
    g = rows.groupBy(group).pivot(split, splits).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(target), F.lit(0)).alias("target"))
    cols = []
    for s in splits:
        n, t = F.coalesce(F.col(f"{s}_n"), F.lit(0)), F.coalesce(F.col(f"{s}_target"), F.lit(0))
        cols += [n.alias(f"{s}_n"), t.alias(f"{s}_target"), F.greatest(t - n, F.lit(0)).alias(f"{s}_left")]
    return g.select(group, *cols)


def reconcile(plan: DataFrame, versions: DataFrame, key: str = "document_key") -> DataFrame:
    """(key, issue): documents of one side only, and those whose splits differ."""
    a = plan.groupBy(key).agg(F.min("split").alias("a"), F.count("*").alias("na"))
    b = versions.groupBy(key).agg(F.min("split").alias("b"), F.max("split").alias("b2"), F.count("*").alias("nb"))
    issue = F.when(F.col("na").isNull(), "not_planned").when(F.col("nb").isNull(), "missing_version").when(F.col("b") != F.col("b2"), "split_disagrees_within").when(F.coalesce("a", F.lit("")) != F.coalesce("b", F.lit("")), "split_differs")
    return a.join(b, key, "full").select(key, issue.alias("issue")).where("issue is not null")


def registration(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """(document_key, action): what happens to each candidate: new, unchanged, resume or reuse.

    candidates: document_key, content_sha256.  registry: document_key, content_sha256,
    status.  The same content is unchanged while a version of it is active, resumed while
    one is staging or failed, else reused.
    """
    known = registry.groupBy("document_key", "content_sha256").agg(F.max((F.col("status") == "active").cast("int")).alias("active"), F.max(F.col("status").isin("staging", "failed").cast("int")).alias("open"))
    action = F.when(F.col("active").isNull(), "new").when(F.col("active") == 1, "unchanged").when(F.col("open") == 1, "resume").otherwise("reuse")
    return candidates.join(known, ["document_key", "content_sha256"], "left").select("document_key", "content_sha256", action.alias("action"))


def activate_latest(versions: DataFrame) -> DataFrame:
    """(version_id, document_key, status): the newest live version of a document is active, earlier ones superseded; failed and deleted stay."""
    live = F.col("status").isin("active", "superseded", "staging")
    w = Window.partitionBy("document_key", live).orderBy(F.col("created_at").desc(), F.col("version_id").desc())
    return versions.select("version_id", "document_key", F.when(live, F.when(F.row_number().over(w) == 1, "active").otherwise("superseded")).otherwise(F.col("status")).alias("status"))


def version_history(versions: DataFrame) -> DataFrame:
    """(document_key, version_id, position, previous): versions of a document from the oldest on."""
    w = Window.partitionBy("document_key").orderBy("created_at", "version_id")
    return versions.select("document_key", "version_id", F.row_number().over(w).alias("position"), F.lag("version_id").over(w).alias("previous"))


def require(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """Fail-closed guard: the rows as they are, or an error at the first row where `bad` holds."""
    return rows.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
