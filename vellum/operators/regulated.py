"""Cells of the regulated table families out of running text, by descriptions and built-in expressions.

A family is described by the regions it is looked for in, by how the numbers of a region
fall into lines, and by the columns of a line.  One evaluator turns lines into cells, so a
text goes through the engine's own expressions and no group or loop is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import plain_label, plain_value

# Titles, rows, columns and header words of the regulated tables.
QUARTERS = ["第一季度", "第二季度", "第三季度", "第四季度"]
QUARTER_ROWS = ["营业收入", "归属于上市公司股东的净利润", "归属于上市公司股东的扣除非经常性损益后的净利润", "经营活动产生的现金流量净额"]
NOTE_ROWS, NOTE_COLUMNS = ["主营业务", "其他业务", "合计"], ["本期收入", "本期成本", "上期收入", "上期成本"]
SEGMENT_TITLES = ["主营业务分行业情况", "主营业务分产品情况", "主营业务分地区情况", "主营业务分销售模式情况"]
SEGMENT_COLUMNS = ["营业收入", "营业成本", "毛利率"]
SEGMENT_HEADS = ["分行业", "分产品", "分地区", "销售模式", "营业收入", "营业成本", "毛利率", "比上年增减", "上年增减", "（%）", "(%)", "百分点"]
SEGMENT_JUNK = ["营业收入", "营业成本", "毛利率", "百分点", "增减"]
ANNUAL_ROWS = ["营业收入", "归属于上市公司股东的净利润", "归属于上市公司股东的扣除非经常性损益的净利润", "经营活动产生的现金流量净额", "归属于上市公司股东的净资产", "总资产", "股本"]
ANNUAL_HEADS = ["2022年", "2022年末", "年末", "年", "（%）", "(%)", "比上年", "同期末", "本期", "增减"]
CONCENTRATION = [("前五名客户", "销售额(万元)", r"前五名客户销售额\s*([0-9,]+(?:\.[0-9]+)?)\s*万元"), ("前五名客户", "销售占比(%)", r"占年度销售总额\s*([0-9.]+)\s*%"), ("前五名供应商", "采购额(万元)", r"前五名供应商采购额\s*([0-9,]+(?:\.[0-9]+)?)\s*万元"), ("前五名供应商", "采购占比(%)", r"占年度采购总额\s*([0-9.]+)\s*%")]
CONCENTRATION_SECTION = "主要销售客户及主要供应商情况"
NUMBER = r"[-−]?[0-9][0-9,]*(?:\.[0-9]+)?"

#: A label and the unbroken run of numbers behind it.
RUN = rf"([^0-9]*?)({NUMBER}(?:\s*{NUMBER})*)"
#: Marks that don't belong to a label.
EDGES = r"^[\s，,。、：:；;（()）]+|[\s，,。、：:；;（()）]+$"


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def _after(text: Column, mark: str) -> Column:
    """What follows the first occurrence of a mark; null where it doesn't occur."""
    at = F.position(F.lit(mark), text)
    return F.when(at > 0, F.substr(text, at + len(mark)))


def _line(row: Column, numbers: Column) -> Column:
    return F.struct(row.alias("row"), numbers.alias("numbers"))


def runs(heads: list[str]) -> Callable[[Column], Column]:
    """Lines: each run of numbers with its label, from which everything up to the last header word is cut."""
    words = "|".join(h.replace("(", "[(]").replace(")", "[)]") for h in heads)

    def lines(region: Column) -> Column:
        found = F.zip_with(F.regexp_extract_all(region, F.lit(RUN), F.lit(1)), F.regexp_extract_all(region, F.lit(RUN), F.lit(2)), lambda label, run: F.struct(label.alias("label"), run.alias("run")))
        bare = lambda label: F.regexp_replace(F.regexp_replace(F.regexp_replace(label, rf"^.*(?:{words})", ""), r"\s+", ""), EDGES, "")
        return F.transform(found, lambda x: _line(bare(x["label"]), _numbers(x["run"])))

    return lines


def in_order(rows: list[str], width: int) -> Callable[[Column], Column]:
    """Lines: the rows that the region names share its numbers evenly, in order; none unless they come out even."""

    def lines(region: Column) -> Column:
        bare = F.regexp_replace(region, " ", "")
        named, numbers = F.filter(F.array(*[F.lit(r) for r in rows]), lambda r: F.contains(bare, r)), _numbers(region)
        even = (F.size(named) > 0) & (F.size(numbers) == width * F.size(named))
        return F.when(even, F.transform(named, lambda r, i: _line(r, F.slice(numbers, i * width + 1, width)))).otherwise(F.array().cast("array<struct<row:string,numbers:array<string>>>"))

    return lines


def behind(rows: list[str], width: int) -> Callable[[Column], Column]:
    """Lines: the first numbers behind each row's name, if there are enough."""

    def lines(region: Column) -> Column:
        each = [_line(F.lit(r), F.slice(_numbers(F.coalesce(_after(region, r), F.lit(""))), 1, width)) for r in rows]
        return F.filter(F.array(*each), lambda x: F.size(x["numbers"]) == width)

    return lines


def whole(text: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("section"), text.alias("text")))


def from_first_quarter(text: Column) -> Column:
    bare = F.regexp_replace(text, r"[（(]\s*[0-9]+\s*[-—]\s*[0-9]+\s*月份?[）)]", "")
    return whole(F.coalesce(_after(bare, QUARTERS[0]), bare))


def titled(text: Column) -> Column:
    """One region for each title, up to the next of the others."""
    regions = []
    for title in SEGMENT_TITLES:
        rest = _after(text, title)
        ends = [F.position(F.lit(other), rest) for other in SEGMENT_TITLES if other != title]
        end = F.least(*[F.when(e > 0, e).otherwise(F.char_length(rest) + 1) for e in ends])
        regions.append(F.when(rest.isNotNull(), F.struct(F.lit(title).alias("section"), F.substr(rest, F.lit(1), end - 1).alias("text"))))
    return F.array_compact(F.array(*regions))


def before_and_at_year_end(text: Column) -> Column:
    """The flows above and the balances below the first year end."""
    at = F.char_length(F.regexp_extract(text, r"^(.*?)20[0-9]{2}\s*年末", 1))
    split = text.rlike(r"20[0-9]{2}\s*年末")
    part = lambda c: F.struct(F.lit("").alias("section"), c.alias("text"))
    return F.when(split, F.array(part(F.substr(text, F.lit(1), at)), part(F.substr(text, at + 1)))).otherwise(F.array(part(text)))


def three_years(region: Column) -> Column:
    years = F.array_distinct(F.regexp_extract_all(region, F.lit(r"(20[0-9]{2})\s*年"), F.lit(1)))
    return F.when(F.size(years) >= 3, F.transform(F.slice(years, 1, 3), lambda y: F.concat(y, F.lit("年"))))


def fixed(columns: list[str]) -> Callable[[Column], Column]:
    return lambda region: F.array(*[F.lit(c) for c in columns])


@dataclass(frozen=True)
class Family:
    """regions of a text, lines of a region, columns of a region; how many numbers a line may have and which of them stand in
    the columns; which labels are rows."""

    regions: Callable[[Column], Column]
    lines: Callable[[Column], Column]
    columns: Callable[[Column], Column]
    places: dict[int, list[int]]
    is_row: Callable[[Column], Column] = lambda row: row != ""


FAMILIES = {
    "quarterly": Family(from_first_quarter, in_order(QUARTER_ROWS, 4), fixed(QUARTERS), {4: [0, 1, 2, 3]}),
    "note_cost": Family(whole, behind(NOTE_ROWS, 4), fixed(NOTE_COLUMNS), {4: [0, 1, 2, 3]}),
    "segment": Family(titled, runs(SEGMENT_HEADS), fixed(SEGMENT_COLUMNS), {5: [0, 1, 2], 6: [0, 1, 2]}, lambda row: (row != "") & (F.char_length(row) <= 24) & ~row.rlike("|".join(SEGMENT_JUNK))),
    "annual_data": Family(before_and_at_year_end, runs(ANNUAL_HEADS), three_years, {3: [0, 1, 2], 4: [0, 1, 3]}, lambda row: row.isin(*ANNUAL_ROWS)),
}


def family_cells(text: Column, family: Family) -> Column:
    """array<struct<row_label, column_label, cell_value, section>> of one family in a text."""
    pick = lambda n: F.coalesce(*[F.when(F.size(n) == size, F.transform(F.array(*[F.lit(p) for p in places]), lambda p: F.get(n, p))) for size, places in family.places.items()])

    def cells(region: Column) -> Column:
        columns = family.columns(region["text"])
        wanted = F.filter(family.lines(region["text"]), lambda x: F.size(x["numbers"]).isin(*family.places) & family.is_row(x["row"]))
        each = F.transform(wanted, lambda x: F.zip_with(columns, pick(x["numbers"]), lambda c, v: F.struct(x["row"].alias("row_label"), c.alias("column_label"), plain_value(v).alias("cell_value"), region["section"].alias("section"))))
        return F.when(columns.isNotNull(), F.flatten(each))

    return F.flatten(F.filter(F.transform(family.regions(text), cells), lambda x: x.isNotNull()))


def concentration_cells(text: Column) -> Column:
    """array<struct>: shares of the five largest customers and suppliers, which stand in sentences."""
    cells = [F.struct(F.lit(r).alias("row_label"), F.lit(c).alias("column_label"), plain_value(F.regexp_extract(text, p, 1)).alias("cell_value"), F.lit(CONCENTRATION_SECTION).alias("section")) for r, c, p in CONCENTRATION]
    return F.filter(F.array(*cells), lambda x: x["cell_value"] != "")


def table_kinds(text: Column) -> Column:
    """The regulated table families that a text shows."""
    t = plain_label(text)
    every = lambda words: [F.contains(t, F.lit(w)) for w in words]
    years = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit("20[0-9]{2}年"), F.lit(0)))) >= 3
    both = lambda cs: cs[0] if len(cs) == 1 else cs[0] & both(cs[1:])
    rules = {
        "quarterly": both(every(QUARTERS)), "note_cost": both(every(["营业收入和营业成本", "本期发生额", "上期发生额", "收入", "成本"])), "segment": t.rlike("|".join(SEGMENT_TITLES)),
        "annual_data": F.contains(t, F.lit("主要会计数据")) & years, "concentration": t.rlike("前五名客户销售额|前五名供应商采购额"),
    }
    return F.array_compact(F.array(*[F.when(rule, kind) for kind, rule in rules.items()]))


def extract_tables(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_kind, row_label, column_label, cell_value, section, cell_no): the cells of all families that the texts show.

    A family whose words a text doesn't show isn't looked for in it; null and empty texts
    show none.  cell_no counts the cells of one family in a text from 0.
    """
    shown = rows.select(F.col(key).alias("key"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("t"), F.explode(table_kinds(F.col(text))).alias("table_kind"))
    cells = F.when(F.col("table_kind") == "concentration", concentration_cells(F.col("t")))
    for kind, family in FAMILIES.items():
        cells = cells.when(F.col("table_kind") == kind, family_cells(F.col("t"), family))
    return shown.withColumn("cells", cells).select("key", "table_kind", F.posexplode("cells").alias("cell_no", "c")).select("key", "table_kind", "c.*", "cell_no")
