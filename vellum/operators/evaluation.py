"""Evaluation of rankings and answers: rates, intervals, stratified reports, paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.runtime import BROADCAST_ROWS, cut

Z95 = 1.959963984540054


def wilson(successes: Column, total: Column) -> Column:
    """struct<low, high>: Wilson's 95 per cent interval of a share; null without observations."""
    n, p = total.cast("double"), successes / total
    centre = p + Z95**2 / (2 * n)
    margin = Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n))
    scale = 1 + Z95**2 / n
    return F.when(total > 0, F.struct(F.greatest((centre - margin) / scale, F.lit(0.0)).alias("low"), F.least((centre + margin) / scale, F.lit(1.0)).alias("high")))


def stratified(rows: DataFrame, dimensions: list[str], success: Column) -> DataFrame:
    """(dimension, stratum, cases, successes, rate, low, high) for every value of every dimension, and for all ('overall', 'all').

    One pass over the rows by grouping sets; rows whose success is null are no cases.
    """
    flagged = rows.select(*[F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias(d) for d in dimensions], success.alias("__ok")).where("__ok is not null")
    sets = [[F.col(d)] for d in dimensions] + [[]]
    counted = flagged.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.count("*").alias("cases"), F.count_if("__ok").alias("successes"), *[F.grouping(d).alias(f"__g_{d}") for d in dimensions])
    named = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.struct(F.lit(d).alias("d"), F.col(d).alias("s"))) for d in dimensions], F.struct(F.lit("overall").alias("d"), F.lit("all").alias("s")))
    grouped = counted.select(named.alias("k"), "cases", "successes")
    w = wilson(F.col("successes"), F.col("cases"))
    return grouped.select(F.col("k.d").alias("dimension"), F.col("k.s").alias("stratum"), "cases", "successes", F.round(F.try_divide("successes", "cases"), 6).alias("rate"), F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


#: Draws of a sample are listed in blocks of this many, so that no array grows with the number of clusters.
DRAWS = 65_536


def clustered_bootstrap(rows: DataFrame, cluster: str, value: str, *, samples: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """One row (low, high, clusters): percentile interval of the mean, whole clusters drawn with replacement.

    Clusters are summed up first, one row each however many there are, and numbered in their order in
    two levels (ranges, rows of a range).  Each draw picks a place in the list of clusters by a
    hash of seed, sample and draw, so the result depends on nothing else.  Clusters are
    spread over samples by an equi-join on their place.  Fewer than two clusters give nulls.
    """
    spark = rows.sparkSession
    sums = rows.where(F.col(value).isNotNull()).groupBy(F.col(cluster).cast("string").alias("c")).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    ranges = cut(sums.repartitionByRange("c").withColumn("range", F.spark_partition_id()))  # cut: the bounds come from a sample
    sizes = ranges.groupBy("range").agg(F.count("*").alias("size"))  # one row a partition
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if total < 2:
        return spark.createDataFrame([(None, None, total)], "low double, high double, clusters long")
    before = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
    placed = ranges.join(F.broadcast(before), "range").select("s", "n", (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("c")) - 1).alias("place"))
    blocks = spark.range(samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(total - 1), F.lit(DRAWS))).alias("first"))
    draws = blocks.select("sample", F.explode(F.sequence("first", F.least(F.col("first") + (DRAWS - 1), F.lit(total - 1)))).alias("draw")).withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "sample", "draw"), F.lit(total)))
    # Spark takes the draws, which it can't count, for the small side
    means = draws.join(placed.hint("broadcast" if total <= BROADCAST_ROWS else "shuffle_hash"), "place").groupBy("sample").agg((F.sum("s") / F.sum("n")).alias("m")).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    tail = (1 - confidence) / 2
    low, high = max(0, int(tail * samples)), min(samples - 1, int((1 - tail) * samples) - 1)
    return means.select(F.get("ms", F.lit(low)).alias("low"), F.get("ms", F.lit(high)).alias("high"), F.lit(total).cast("long").alias("clusters"))


def compare_runs(old: DataFrame, new: DataFrame, key: str, success: str) -> DataFrame:
    """(change, cases) of two runs over the same keys: fixed, regressed, both, neither; a key of one run only is 'unpaired'."""
    a, b = old.select(key, F.col(success).alias("a")), new.select(key, F.col(success).alias("b"))
    change = F.when(F.col("a").isNull() | F.col("b").isNull(), "unpaired").when(~F.col("a") & F.col("b"), "fixed").when(F.col("a") & ~F.col("b"), "regressed").when(F.col("a"), "both").otherwise("neither")
    return a.join(b, key, "full").groupBy(change.alias("change")).agg(F.count("*").alias("cases"))


def macro_mean(rows: DataFrame, inner: str, outer: str | None, value: str) -> DataFrame:
    """Mean of means: value over `inner`, then over each `outer` (or all)."""
    means = rows.groupBy(*([outer] if outer else []), inner).agg(F.avg(value).alias("m"))
    return (means.groupBy(outer) if outer else means.groupBy()).agg(F.avg("m").alias("macro_mean"), F.count("*").alias("groups"))


def multi_label_rates(rows: DataFrame, labels: str, success: Column) -> DataFrame:
    """(label, cases, successes, rate) for each label of an array; a case counts for each of its labels once."""
    one = rows.select(F.explode(F.array_distinct(labels)).alias("label"), success.alias("ok"))
    return one.groupBy("label").agg(F.count("*").alias("cases"), F.count_if("ok").alias("successes"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("rate"))


def nearest_percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, one column a share, largest): the value at round((n - 1) * share) of each group's order, halves to even.

    Equal values are counted before they are shuffled and summed up in two levels (blocks of
    values by range, values of a block), so no group is gathered, however large.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    ranged = cut(counts.repartitionByRange(group, value).withColumn("__part", F.spark_partition_id()))  # cut: the bounds come from a sample
    blocks = ranged.groupBy(group, "__part").agg(F.sum("n").alias("n"))  # one row a partition and group
    before = blocks.select(group, "__part", (F.sum("n").over(Window.partitionBy(group).orderBy("__part")) - F.col("n")).alias("before"))
    total = blocks.groupBy(group).agg(F.sum("n").alias("total"))
    inside = Window.partitionBy(group, "__part").orderBy(value)
    upto = ranged.join(before, [group, "__part"]).join(total, group).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    at = lambda share: F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * F.lit(share), 0), F.col(value)))
    return upto.groupBy(group).agg(F.max("total").alias("n"), *[at(s).alias(name) for name, s in shares.items()], F.max(value).alias("largest"))


def coverage(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, covered): mean over the rows that have the metric, and their share."""
    cols = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    return rows.select(F.inline(cols)).groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.count("v") / F.count("*"), 6).alias("covered"))
