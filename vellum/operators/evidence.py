"""Evidence: merging regions, nearest labels, authority, binding to targets, checks of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import number_tokens, plain_label
from vellum.operators.answers import CANONICAL, signed_numbers
from vellum.operators.retrieval import rank_fusion, top
from vellum.operators.tables import intersection_share

# Sections and how much authority they lend.
AUTHORITY = {"财务摘要": 50, "关键指标": 45, "业绩综述": 35, "主要经营业绩": 30, "内含价值分析": 20, "董事长致辞": 5}


#: Height of the stripes of a page that boxes meet by.
STRIPE = 40.0


def merge_regions(native: DataFrame, recognised: DataFrame, page: list[str], overlap: float = 0.6) -> DataFrame:
    """Native regions and those recognised ones that add something, numbered by place (reading_order).

    native and recognised: the page's columns, box_id, text, box.  A recognised region is
    left out if its text, blanks aside, stands natively on the page, or if a native region
    covers at least `overlap` of it.  Null and blank texts are compared by place only.
    """
    own = native.select(*page, plain_label(F.col("text")).alias("compact")).where("compact <> ''").distinct()
    fresh = recognised.withColumn("compact", F.when(plain_label(F.col("text")) != "", plain_label(F.col("text")))).join(own, [*page, "compact"], "left_anti")
    # boxes meet by horizontal stripes of the page, so a page isn't joined with itself
    stripes = lambda box: F.explode(F.sequence(F.floor(box["y0"] / STRIPE), F.greatest(F.floor(box["y0"] / STRIPE), F.floor(box["y1"] / STRIPE))))
    boxes = native.where("box is not null").select(*page, F.col("box").alias("__n"), stripes(F.col("box")).alias("__s"))
    covered = fresh.where("box is not null").withColumn("__s", stripes(F.col("box"))).join(boxes, [*page, "__s"]).where(intersection_share(F.col("box"), F.col("__n")) >= overlap).select(*page, "box_id").distinct()
    kept = fresh.join(covered, [*page, "box_id"], "left_anti")
    both = native.select(*page, "box_id", "text", "box", F.lit("native").alias("origin")).unionByName(kept.select(*page, "box_id", "text", "box", F.lit("recognised").alias("origin")))
    return both.withColumn("reading_order", F.row_number().over(Window.partitionBy(*page).orderBy("box.y0", "box.x0", "origin", "box_id")) - 1)


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """A box moved into its page; null if nothing of it lies there."""
    x = lambda c: F.greatest(F.least(c, width), F.lit(0.0))
    y = lambda c: F.greatest(F.least(c, height), F.lit(0.0))
    b = F.struct(x(box["x0"]).alias("x0"), y(box["y0"]).alias("y0"), x(box["x1"]).alias("x1"), y(box["y1"]).alias("y1"))
    return F.when((b["x1"] > b["x0"]) & (b["y1"] > b["y0"]), b)


def nearest_boxes(left: DataFrame, right: DataFrame, page: list[str], reach: float = 20.0) -> DataFrame:
    """(page, left_id, right_id, distance): for each left box the nearest right one of its page within reach; ties by id.

    Boxes meet by vertical stripes of the reach's height, so a page isn't joined with itself.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    a = left.select(*page, F.col("box_id").alias("left_id"), x.alias("ax"), y.alias("ay")).withColumn("stripe", F.floor(F.col("ay") / reach))
    b = right.select(*page, F.col("box_id").alias("right_id"), x.alias("bx"), y.alias("by")).withColumn("stripe", F.explode(F.array(*[F.floor(F.col("by") / reach) + i for i in (-1, 0, 1)])))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    near = a.join(b, [*page, "stripe"]).withColumn("distance", F.round(d, 6)).where(F.col("distance") <= reach)
    return top(near.withColumn("__k", F.struct(*page, "left_id")), "__k", [F.col("distance"), F.col("right_id")], 1).select(*page, "left_id", "right_id", "distance")


def authority(query: Column, section: Column, text: Column) -> Column:
    """Points of a source: its sections, comparable or adjusted figures where asked for, and twelve for each metric it shares with the question."""
    context = F.concat_ws(" ", section, text)
    points = F.lit(0)
    for cue, weight in AUTHORITY.items():
        points = points + F.when(F.contains(context, F.lit(cue)), weight).otherwise(0)
    points = points + F.when(F.contains(query, F.lit("可比")) & F.contains(context, F.lit("可比口径")), 30).otherwise(0)
    points = points + F.when(F.contains(query, F.lit("调整后")) & context.rlike("调整后|追溯调整"), 20).otherwise(0)
    shared = F.filter(F.array(*[F.lit(m) for m in CANONICAL]), lambda m: F.contains(query, m) & F.contains(context, m))
    return points + 12 * F.size(shared)


def bind_targets(evidence: DataFrame) -> DataFrame:
    """(chunk_id, targets, uses): evidence rows merged by chunk, with the targets they serve, each once."""
    return evidence.where("chunk_id is not null").groupBy("chunk_id").agg(F.sort_array(F.collect_set("target")).alias("targets"), F.count("*").alias("uses"))


def sufficiency(targets: DataFrame, evidence: DataFrame, least: int = 1) -> DataFrame:
    """(target, chunks, sufficient): distinct chunks for each wanted target, also for those with none."""
    n = evidence.where("chunk_id is not null").groupBy("target").agg(F.countDistinct("chunk_id").alias("chunks"))
    return targets.select("target").distinct().join(n, "target", "left").select("target", F.coalesce("chunks", F.lit(0)).alias("chunks"), (F.coalesce("chunks", F.lit(0)) >= least).alias("sufficient"))


def weight_sweep(ranked: DataFrame, grid: list[tuple[float, float]], *, k: int = 5) -> DataFrame:
    """Rank fusion for each pair of weights of a short list: adds weights ('a:b')."""
    out = None
    for a, b in grid:
        one = rank_fusion(ranked, weights={"lexical_rank": a, "dense_rank": b}, k=k).withColumn("weights", F.lit(f"{a:g}:{b:g}"))
        out = one if out is None else out.unionByName(one)
    return out


def claim_risks(claim: Column, evidence: Column, contract: Column) -> Column:
    """array<struct<check, severity>>: explicit conflicts of a claim with its evidence and with what was asked."""
    numbers, known = number_tokens(claim), F.concat(number_tokens(evidence), number_tokens(contract))
    years = lambda c: F.regexp_extract_all(c, F.lit("(?:19|20)[0-9]{2}"), F.lit(0))
    negative = F.transform(F.filter(signed_numbers(claim), lambda x: x.startswith("-")), lambda x: F.regexp_replace(x, "^-", ""))
    metrics = lambda c: F.filter(F.array(*[F.lit(m) for m in CANONICAL]), lambda m: F.contains(c, m))
    checks = {
        ("unsupported_number", "reject"): F.size(F.array_except(numbers, known)) > 0,
        ("unsupported_year", "review"): F.size(F.array_except(years(claim), F.concat(years(evidence), years(contract)))) > 0,
        ("sign_conflict", "reject"): F.size(F.array_intersect(negative, F.filter(signed_numbers(contract), lambda x: ~x.startswith("-")))) > 0,
        ("missing_metric", "review"): F.size(F.array_except(metrics(contract), metrics(claim))) > 0,
        ("no_evidence", "reject"): F.coalesce(F.trim(evidence) == "", F.lit(True)),
    }
    return F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"))) for (name, severity), rule in checks.items()]))


def verdict(risks: Column) -> Column:
    """reject before review before pass."""
    return F.when(F.exists(risks, lambda r: r["severity"] == "reject"), "reject").when(F.size(risks) > 0, "review").otherwise("pass")


def within_budget(rows: DataFrame, group: str, order: list[str], text: str, most: int) -> DataFrame:
    """Rows of each group in order as long as their texts stay within a number of characters together."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.char_length(text)).over(w)).where(F.col("used") <= most)


def interleave(first: DataFrame, second: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows of two sides of a group by turns, the first side leading: adds side and position."""
    number = lambda df, side: df.withColumn("side", F.lit(side)).withColumn("__i", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    both = number(first, 0).unionByName(number(second, 1))
    return both.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("__i", "side"))).drop("__i")


def judged_usage(gold: DataFrame, negative: DataFrame) -> DataFrame:
    """(chunk_id, gold_for, negative_for): the questions each chunk is judged for."""
    both = gold.select("chunk_id", "query_id", F.lit(True).alias("g")).unionByName(negative.select("chunk_id", "query_id", F.lit(False).alias("g")))
    return both.groupBy("chunk_id").agg(F.sort_array(F.collect_set(F.when(F.col("g"), F.col("query_id")))).alias("gold_for"), F.sort_array(F.collect_set(F.when(~F.col("g"), F.col("query_id")))).alias("negative_for"))
