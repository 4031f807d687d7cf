"""Answers out of table cells, as rows with their numbers: totals, differences, shares; and plans of comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.finance import any_of, report_years, years
from vellum.operators.answers import metric_mentions


def exact(value: str | Column) -> Column:
    """A plain number as a decimal, null for anything else."""
    return F.col(value).try_cast("decimal(24,4)") if isinstance(value, str) else value.try_cast("decimal(24,4)")


def preferred_cells(structured: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """The structured cells, and those extracted from text where a key has no structured ones."""
    return structured.withColumn("origin", F.lit("structured")).unionByName(extracted.join(structured.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("text")))


def year_values(cells: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(key, row_label, year, value, exact_year) for wanted (key, year): the cell of the year's column, else the row's first cell.

    cells: key, row_label, column_label, cell_value, cell_no.
    """
    j = cells.join(wanted, key)
    own = F.col("column_label") == F.concat(F.col("year").cast("string"), F.lit("年"))
    g = j.groupBy(key, "year", "row_label").agg(F.min_by("cell_value", F.when(own, F.col("cell_no"))).alias("own"), F.min_by("cell_value", "cell_no").alias("first"))
    return g.select(key, "row_label", "year", F.coalesce("own", "first").alias("value"), F.col("own").isNotNull().alias("exact_year"))


def quarter_totals(quarterly: DataFrame, annual: DataFrame, key: str) -> DataFrame:
    """(key, row_label, total, annual, difference, agrees): the four quarters of a row summed up against the annual value.

    quarterly: key, row_label, cell_value.  annual: key, row_label, value.  Rows with fewer or
    more than four quarters, or a quarter that is no number, give none.
    """
    four = quarterly.groupBy(key, "row_label").agg(F.count("*").alias("n"), F.count(exact("cell_value")).alias("numbers"), F.sum(exact("cell_value")).alias("total")).where("n = 4 and numbers = 4")
    j = four.join(annual.select(key, "row_label", exact("value").alias("annual")), [key, "row_label"], "left")
    difference = F.col("total") - F.col("annual")
    return j.select(key, "row_label", F.col("total").cast("decimal(24,4)").alias("total"), "annual", difference.cast("decimal(24,4)").alias("difference"), (difference == 0).alias("agrees"))


def _cell(rows: str | list[str], column: str) -> Column:
    labels = [rows] if isinstance(rows, str) else rows
    return F.min(F.when(F.col("row_label").isin(*labels) & (F.col("column_label") == column), exact("cell_value")))


def note_differences(cells: DataFrame, key: str) -> DataFrame:
    """(key, measure, main, total, other, agrees): what a note's total has beyond the main business, and whether its other row says so."""
    sides = {"cost": "本期成本", "revenue": "本期收入"}
    g = cells.groupBy(key).agg(*[_cell(row, column).alias(f"{m}_{n}") for m, column in sides.items() for n, row in (("main", "主营业务"), ("total", "合计"), ("other", "其他业务"))])
    each = g.select(key, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_main").alias("main"), F.col(f"{m}_total").alias("total"), F.col(f"{m}_other").alias("stated")) for m in sides])))
    other = (F.col("total") - F.col("main")).cast("decimal(24,4)")
    return each.where("main is not null and total is not null").select(key, "measure", "main", "total", other.alias("other"), (other == F.col("stated")).alias("agrees"))


def scope_differences(totals: DataFrame, key: str) -> DataFrame:
    """(key, consolidated, parent, difference, higher): the first total of each scope compared; keys that lack one give no row.

    totals: key, scope, ordinal, value.
    """
    first = lambda s: F.min_by("value", F.when(F.col("scope") == s, F.col("ordinal")))
    g = totals.groupBy(key).agg(first("consolidated").alias("consolidated"), first("parent").alias("parent")).where("consolidated is not null and parent is not null")
    d = (F.col("consolidated") - F.col("parent")).cast("decimal(24,4)")
    return g.select(key, "consolidated", "parent", F.abs(d).alias("difference"), F.when(d >= 0, "consolidated").otherwise("parent").alias("higher"))


REPORTED = "归属于上市公司股东的净利润"
DEDUCTED = ["归属于上市公司股东的扣除非经常性损益的净利润", "归属于上市公司股东的扣除非经常性损益后的净利润"]


def profit_differences(values: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, reported, deducted, nonrecurring, stated): reported less deducted profit, and whether a text of the key states that amount.

    values: key, row_label, value.  texts: key, text.
    """
    of = lambda labels: F.min(F.when(F.col("row_label").isin(*labels), exact("value")))
    g = values.groupBy(key).agg(of([REPORTED]).alias("reported"), of(DEDUCTED).alias("deducted")).where("reported is not null and deducted is not null")
    g = g.withColumn("nonrecurring", (F.col("reported") - F.col("deducted")).cast("decimal(24,4)"))
    shown = F.contains(F.regexp_replace("text", r"\s+", ""), F.format_number(F.bround("nonrecurring", 2), 2))
    stated = g.join(texts.select(key, "text"), key).groupBy(key).agg(F.max(shown.cast("int")).alias("s"))
    return g.join(stated, key, "left").select(key, "reported", "deducted", "nonrecurring", (F.coalesce("s", F.lit(0)) == 1).alias("stated"))


def segment_margins(cells: DataFrame, key: str) -> DataFrame:
    """(key, section, row_label, margin, place): gross margins of each section of a key from the highest down; a repeated row counts once, the first."""
    m = cells.where(F.col("column_label") == "毛利率").groupBy(key, "section", "row_label").agg(F.min_by(exact("cell_value"), "cell_no").alias("margin")).where("margin is not null")
    return m.withColumn("place", F.row_number().over(Window.partitionBy(key, "section").orderBy(F.col("margin").desc(), "row_label")))


def pair_differences(values: DataFrame, group: list[str], item: str, value: str) -> DataFrame:
    """(group, higher, lower, difference): for groups of exactly two items, which is higher and by how much."""
    g = values.groupBy(*group).agg(F.count("*").alias("n"), F.max_by(item, F.struct(value, item)).alias("higher"), F.min_by(item, F.struct(value, item)).alias("lower"), (F.max(value) - F.min(value)).cast("decimal(24,4)").alias("difference"))
    return g.where("n = 2").drop("n")


# How reports refuse to promise, and how they state a plan.
NO_PROMISE = ["不构成对投资者的业绩承诺", "不构成业绩承诺"]
PLANNED = r"计划实现营业总收入([0-9][0-9,]*(?:\.[0-9]+)?)亿元"


def refused_promises(texts: DataFrame, key: str) -> DataFrame:
    """(key, year, target): texts that state a planned revenue and that it is no promise."""
    bare = F.regexp_replace("text", r"\s+", "")
    return texts.select(key, bare.alias("t")).where(any_of(F.col("t"), NO_PROMISE) & F.col("t").rlike(PLANNED)).select(key, F.regexp_extract("t", "20[0-9]{2}", 0).alias("year"), F.regexp_extract("t", PLANNED, 1).alias("target"))


def comparison_targets(queries: DataFrame, mentions: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, company, fact_year, document_year, scope, version, together) for questions that compare; clarification where they can't be planned.

    queries: query_id, query.  mentions: query_id, company, position.  Both sides of a
    statement, both versions of a restated year, companies by years, or the years of one
    company; in this order.  More than `most` targets are refused.
    """
    named = mentions.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "company"))), lambda x: x["company"]).alias("companies"))
    q = queries.join(named, "query_id", "left").withColumn("companies", F.coalesce("companies", F.array().cast("array<string>")))
    text = F.col("query")
    q = q.withColumn("ys", years(text)).withColumn("reports", report_years(text))
    one, single = F.get("companies", F.lit(0)), F.size("companies") == 1
    last = F.element_at("reports", -1)
    facts = F.filter("ys", lambda y: y != last)
    target = lambda company, year, document, scope, version, together: F.struct(company.alias("company"), year.alias("fact_year"), document.alias("document_year"), F.lit(scope).alias("scope"), (version if isinstance(version, Column) else F.lit(version)).alias("version"), together.alias("together"))
    y0, none = F.get("ys", F.lit(0)), F.lit(None).cast("string")
    scopes = F.array(*[target(one, y0, y0, s, "current", F.lit("scope")) for s in ("consolidated", "parent")])
    versions = F.array(*[target(one, F.get(facts, F.lit(0)), last, "unspecified", v, F.lit("restatement")) for v in ("as_reported", "restated")])
    adjusted = F.when(F.contains(text, F.lit("调整后")) & (F.size("reports") > 0), last)
    grouped = F.when(any_of(text, ["调整", "同比", "增长率"]), "comparative-table")

    def of_year(company: Column, year: Column) -> Column:
        document = F.when(adjusted.isNotNull() & (year <= adjusted), adjusted).otherwise(year)
        return target(company, year, document, "unspecified", F.when(adjusted.isNotNull() & (year < adjusted), "restated").otherwise("current"), grouped)

    wide = F.when(F.size("ys") >= 2, F.col("ys")).otherwise(F.array(y0))
    by_company = F.flatten(F.transform("companies", lambda c: F.transform(wide, lambda y: of_year(c, y))))
    by_year = F.transform("ys", lambda y: of_year(one, y))
    both = F.contains(text, F.lit("合并")) & F.contains(text, F.lit("母公司"))
    restated = F.contains(text, F.lit("调整前")) & F.contains(text, F.lit("调整后")) & single & (F.size("reports") > 0) & (F.size(facts) == 1)
    plan = F.when(both & single & (F.size("ys") == 1), scopes).when(both, None).when(restated, versions).when(F.size("companies") >= 2, by_company).when(F.size("ys") >= 2, by_year)
    q = q.withColumn("plan", plan)
    trouble = F.when(F.col("plan").isNull() & both, "scope").when(F.col("plan").isNull(), "objects").when(F.size("plan") > most, "budget")
    rows = q.withColumn("clarification", trouble).withColumn("plan", F.when(trouble.isNull(), F.col("plan")).otherwise(F.array(target(none, F.lit(None).cast("int"), F.lit(None).cast("int"), "unspecified", "none", none))))
    return rows.select("query_id", F.posexplode("plan").alias("place", "t"), "clarification", metric_mentions(text).alias("metrics")).select("query_id", "place", "t.*", "clarification", F.array_join("metrics", ",").alias("metrics"))
