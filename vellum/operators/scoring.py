"""Scores of extraction, answers and runs: agreement of sets, lanes, coverage, failures, audits of datasets and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import number_tokens


def complete_rows(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row (complete, rows): rows that have all metrics, and all rows."""
    every = F.lit(True)
    for m in metrics:
        every = every & F.col(m).isNotNull()
    return rows.agg(F.count_if(every).alias("complete"), F.count("*").alias("rows"))


def lane_rates(rows: DataFrame, lane: str, flags: dict[str, Column], attempted: dict[str, Column] | None = None) -> DataFrame:
    """(lane, cases, one rate a flag): shares of rows by lane; a flag in `attempted` counts only the rows that try it, null if none does."""
    rates = [F.round(F.avg(F.when((attempted or {}).get(n, F.lit(True)), f.cast("int"))), 6).alias(n) for n, f in flags.items()]
    return rows.groupBy(F.coalesce(lane, F.lit("(none)")).alias("lane")).agg(F.count("*").alias("cases"), *rates)


def lane_deltas(rates: DataFrame, base: str, other: str, columns: list[str]) -> DataFrame:
    """(metric, base, other, delta): two lanes side by side; a lane that is missing leaves nulls."""
    side = lambda lane, c: F.max(F.when(F.col("lane") == lane, F.col(c)))
    one = rates.agg(*[side(lane, c).alias(f"{n}_{c}") for n, lane in (("base", base), ("other", other)) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"base_{c}").cast("double").alias("base"), F.col(f"other_{c}").cast("double").alias("other")) for c in columns]))).withColumn("delta", F.round(F.col("other") - F.col("base"), 6))


def set_agreement(reference: DataFrame, candidate: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(group, expected, found, shared, precision, recall, f1) of distinct rows of both sides by group, and micro totals as '(all)'.

    Nulls are equal to nulls; a side without rows has precision or recall 0.
    """
    side = lambda df, n: df.select(group, *keys).distinct().withColumn(n, F.lit(1))
    both = side(reference, "a").withColumn("b", F.lit(0)).unionByName(side(candidate, "b").withColumn("a", F.lit(0))).groupBy(group, *keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = both.groupBy(group).agg(F.sum("a").alias("expected"), F.sum("b").alias("found"), F.sum(F.col("a") * F.col("b")).alias("shared"))
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "found", "shared")]).withColumn(group, F.lit("(all)"))
    out = counts.unionByName(totals)
    p, r = F.coalesce(F.try_divide("shared", "found"), F.lit(0.0)), F.coalesce(F.try_divide("shared", "expected"), F.lit(0.0))
    return out.select(group, "expected", "found", "shared", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * F.col("shared"), F.col("found") + F.col("expected")), F.lit(0.0)), 6).alias("f1"))


def area_ratios(boxes: DataFrame, page: list[str], width: float, height: float) -> DataFrame:
    """(page, area_ratio): share of the page that its boxes take together, at most 1."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return boxes.groupBy(*page).agg(F.round(F.least(F.lit(1.0), F.sum(area) / (width * height)), 6).alias("area_ratio"))


def set_differences(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """Adds missing, extra and exact: what only one of two arrays holds, and whether neither holds more."""
    return rows.withColumn("missing", F.array_sort(F.array_except(expected, actual))).withColumn("extra", F.array_sort(F.array_except(actual, expected))).withColumn("exact", (F.size("missing") == 0) & (F.size("extra") == 0))


def fact_coverage(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, facts, covered, coverage): facts of a case one of whose values stands in one of its hits, blanks and commas aside.

    facts: case_id, fact_id, value (one row a value).  hits: case_id, text.  Values and texts
    meet by case only; a case without facts gives no row.
    """
    bare = lambda c: F.regexp_replace(c, r"[\s,，]", "")
    met = facts.join(hits.select("case_id", bare(F.col("text")).alias("__t")), "case_id").where((bare(F.col("value")) != "") & F.contains("__t", bare(F.col("value")))).select("case_id", "fact_id").distinct().withColumn("met", F.lit(1))
    each = facts.select("case_id", "fact_id").distinct().join(met, ["case_id", "fact_id"], "left")
    return each.groupBy("case_id").agg(F.count("*").alias("facts"), F.count("met").alias("covered"), F.round(F.count("met") / F.count("*"), 6).alias("coverage"))


def failure_class(lexical: Column, dense: Column, near: int = 5) -> Column:
    """Why a case's gold wasn't found, from its best rank of each retriever: the first rule that holds."""
    a, b = F.coalesce(lexical <= near, F.lit(False)), F.coalesce(dense <= near, F.lit(False))
    return F.when(a & b, "found").when(a, "lexical_only").when(b, "dense_only").when(lexical.isNotNull() | dense.isNotNull(), "ranked_low").otherwise("not_retrieved")


def grid_supports(boxes: DataFrame, page: list[str], x_step: float = 15.0, y_step: float = 4.0) -> DataFrame:
    """(page, columns, widest): columns of a grid that two or more rows support, and the most rows that one has."""
    cells = boxes.groupBy(*page, F.round(F.col("x0") / x_step).alias("__x")).agg(F.countDistinct(F.round(F.col("y0") / y_step)).alias("rows"))
    return cells.groupBy(*page).agg(F.count_if(F.col("rows") >= 2).alias("columns"), F.max("rows").alias("widest"))


def labelled(rows: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows with each label whose rule holds: adds label and label_score (rules: label -> rule, score)."""
    labels = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(n).alias("label"), score.cast("double").alias("label_score"))) for n, (rule, score) in rules.items()]))
    return rows.withColumn("__l", F.explode(labels)).select(*rows.columns, "__l.label", "__l.label_score")


def first_failing(gates: dict[str, Column]) -> Column:
    """Name of the first gate that does not hold (null counts as not holding), 'eligible' if all do."""
    out = F.lit("eligible")
    for name, gate in reversed(gates.items()):
        out = F.when(~F.coalesce(gate, F.lit(False)), name).otherwise(out)
    return out


def bind_by_numbers(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, most: int = 4) -> DataFrame:
    """(group, left_id, right_id, shared, place): partners of a group that share numbers, the `most` best by how many.

    left and right: group, their id, text.  They meet on (group, number), so no side is paired whole.
    """
    words = lambda df, i: df.select(group, i, F.explode(F.array_distinct(number_tokens(F.col("text")))).alias("number"))
    shared = words(left, left_id).join(words(right, right_id), [group, "number"]).groupBy(group, left_id, right_id).agg(F.count("*").alias("shared"))
    w = Window.partitionBy(group, left_id).orderBy(F.col("shared").desc(), right_id)
    return shared.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def last_before(rows: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last non-null value up to each row in the order of its group (carried across pages)."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def renumbered(rows: DataFrame, group: str, order: list[str], item: str) -> DataFrame:
    """(group, item, number): the items of a group numbered by where they first appear."""
    first = rows.withColumn("__o", F.struct(*order)).groupBy(group, item).agg(F.min("__o").alias("__o"))
    return first.select(group, item, F.row_number().over(Window.partitionBy(group).orderBy("__o", item)).alias("number"))


def complete_bundles(cells: DataFrame, table: str, row: str, column: str) -> DataFrame:
    """(table, row, columns, complete): whether a row has all columns that its table has anywhere."""
    width = cells.groupBy(table).agg(F.countDistinct(column).alias("width"))
    own = cells.groupBy(table, row).agg(F.countDistinct(column).alias("columns"))
    return own.join(width, table).select(table, row, "columns", (F.col("columns") == F.col("width")).alias("complete"))


def period_label(label: Column) -> Column:
    """A label of a period in one wording: the beginning and the end of a year are those of the period."""
    bare = F.regexp_replace(label, r"\s+", "")
    return F.regexp_replace(F.regexp_replace(bare, "年初|上年末|上年年末", "期初"), "(?:本)?年末", "期末")


def company_mentions(queries: DataFrame, names: DataFrame, longest: int = 40) -> DataFrame:
    """(query_id, company, position): the names that a question holds, and where each first stands.

    queries: query_id, query.  names: company.  Parts of a question of the lengths that names
    have meet the names by an equi-join, so questions and names are never paired whole.
    """
    known = names.where(F.col("company") != "").select("company").distinct()
    lengths = sorted(r[0] for r in known.select(F.char_length("company").alias("n")).where(F.col("n") <= longest).distinct().collect())  # at most `longest` numbers
    if not lengths:
        return queries.select("query_id", F.lit("").alias("company"), F.lit(0).alias("position")).limit(0)

    def of_length(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.char_length("query") - n + 1, F.lit(1)))
        parts = F.transform(places, lambda i: F.struct(F.substr(F.col("query"), i, F.lit(n)).alias("company"), i.alias("position")))
        return F.when(F.char_length("query") >= n, parts).otherwise(F.array().cast("array<struct<company:string,position:int>>"))

    parts = F.flatten(F.array(*[of_length(n) for n in lengths]))
    return queries.select("query_id", F.explode(parts).alias("p")).select("query_id", "p.*").join(known, "company").groupBy("query_id", "company").agg(F.min("position").alias("position"))


def money(value: Column) -> Column:
    """An amount with thousands separators and two decimals, halves to even."""
    return F.format_number(F.bround(value, 2), 2)


def pdf_time(literal: Column) -> Column:
    """UTC time of a PDF date literal (D:YYYYMMDDhhmmss, shorter ones filled up, zone +hh'mm'); null if it is none."""
    digits = F.regexp_extract(literal, r"^(?:D:)?([0-9]{4,14})", 1)
    full = F.concat(digits, F.substr(F.lit("00000101000000"), F.char_length(digits) + 1))
    local = F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss"))
    sign = F.when(F.regexp_extract(literal, r"([+-])[0-9]{2}'?[0-9]{2}", 1) == "-", -1).otherwise(1)
    part = lambda i: F.coalesce(F.regexp_extract(literal, r"[+-]([0-9]{2})'?([0-9]{2})", i).try_cast("int"), F.lit(0))
    return F.when(digits != "", F.timestamp_seconds(F.unix_timestamp(local) - sign * (part(1) * 3600 + part(2) * 60)))


def mutate_number(text: Column) -> Column:
    """The text with its first number raised by one in the last digit, nine to zero: a fault that checks must find."""
    number = F.regexp_extract(text, r"([0-9][0-9,.]*[0-9]|[0-9])", 1)
    at = F.position(number, text)
    last = F.translate(F.right(number, F.lit(1)), "0123456789", "1234567890")
    return F.when(number == "", text).otherwise(F.concat(F.substr(text, F.lit(1), at + F.char_length(number) - 2), last, F.substr(text, at + F.char_length(number))))


def drop_longest_clause(text: Column) -> Column:
    """The text without its longest clause (the first of equals); a single clause stays."""
    clauses = F.split(text, "[，,；;。]")
    size = F.array_max(F.transform(clauses, F.char_length))
    place = F.array_position(F.transform(clauses, F.char_length), size)
    rest = F.transform(F.filter(F.transform(clauses, lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i"))), lambda x: x["i"] != place), lambda x: x["c"])
    return F.when(F.size(clauses) > 1, F.array_join(rest, "，")).otherwise(text)


def value_span(text: Column, value: Column) -> Column:
    """Place of a number in a text (from 1), blanks and commas between its digits allowed; 0 where it doesn't stand."""
    digits = F.split(F.regexp_replace(value, r"[\s,]", ""), "")
    escaped = F.transform(F.filter(digits, lambda c: c != ""), lambda c: F.when(c.rlike("[0-9A-Za-z%]"), c).otherwise(F.concat(F.lit("["), c, F.lit("]"))))
    return F.when(F.size(escaped) > 0, F.regexp_instr(text, F.array_join(escaped, r"[\s,]*"))).otherwise(0)


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, votes): the most frequent non-null value of each group, ties by value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("votes"))
    return n.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.col("votes").desc(), value))).where("__r = 1").drop("__r")
