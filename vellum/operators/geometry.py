"""Tokens of a page by their places: pieces of spans, joined fragments, label segments, rows by centre lines, columns by headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A number inside a span, and whatever stands between numbers.
PIECE = r"[-−]?[0-9][0-9,]*(?:\.[0-9]+)?%?|[^0-9−-]+|[-−]"
NUMERIC = r"^[-−]?[0-9][0-9,]*(?:\.[0-9]+)?%?$"
#: Headers that hold digits but are labels.
HEADER = r"^(?:20[0-9]{2}年(?:末|度)?|第[一二三四1-4]季度)$"
PUNCTUATION = r"^[\s\x{00a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}.,，。、:：;；()（）\-—_/]*$"


def split_spans(spans: DataFrame) -> DataFrame:
    """(box_id, piece_no, text, numeric, x0, x1) of the pieces of each span: numbers apart from labels, boxes in proportion to characters.

    spans: box_id, text, x0, x1.  Pieces of blanks or punctuation only are left out; a year
    or quarter header stays whole.
    """
    whole = F.regexp_replace("text", r"\s+", "").rlike(HEADER)
    pieces = F.when(whole, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"({PIECE})"), F.lit(1)))
    rows = spans.where("text is not null").withColumn("pieces", pieces)
    ends = F.transform("pieces", lambda p, i: F.aggregate(F.slice("pieces", 1, i + 1), F.lit(0), lambda a, x: a + F.char_length(x)))
    rows = rows.withColumn("ends", ends).select("box_id", "x0", "x1", F.char_length("text").alias("n"), F.posexplode(F.arrays_zip("pieces", "ends")).alias("piece_no", "p"))
    text, end = F.col("p.pieces"), F.col("p.ends")
    lead = F.char_length(text) - F.char_length(F.ltrim(text))
    begin = end - F.char_length(text) + lead
    stop = begin + F.char_length(F.trim(text))
    width = F.greatest(F.lit(0.01), F.col("x1") - F.col("x0"))
    at = lambda k: F.round(F.col("x0") + width * k / F.greatest(F.col("n"), F.lit(1)), 4)
    out = rows.select("box_id", "piece_no", F.trim(text).alias("text"), F.trim(text).rlike(NUMERIC).alias("numeric"), at(begin).alias("x0"), at(stop).alias("x1"))
    return out.where(~F.col("text").rlike(PUNCTUATION))


def join_fragments(tokens: DataFrame, row: list[str]) -> DataFrame:
    """(row, first_id, text, x0, x1, parts): numbers drawn in several spans ('360' ',' '403') as one; other tokens as they are.

    tokens: row columns, box_id, text, x0, x1, height.  A separator joins the numbers on both
    sides if the gaps are tight; only what makes a well-formed number together is joined.
    """
    w = Window.partitionBy(*row).orderBy("x0", "box_id")
    numeric, mark = F.col("text").rlike(r"^[-−]?[0-9][0-9,.]*%?$"), F.col("text").isin(",", ".")
    tight = (F.lead("x0").over(w) - F.col("x1")) <= F.greatest(F.lit(3.0), F.col("height") * 0.45)
    t = tokens.withColumn("num", numeric).withColumn("mark", mark).withColumn("tight", F.coalesce(tight, F.lit(False)))
    # from a number over a separator to a number
    over = F.col("num") & F.col("tight") & F.lead("mark").over(w) & F.lead("tight").over(w) & F.lead("num", 2).over(w)
    t = t.withColumn("over", F.coalesce(over, F.lit(False)))
    joined = F.coalesce(F.lag("over").over(w), F.lit(False)) | F.coalesce(F.lag("over", 2).over(w), F.lit(False))
    t = t.withColumn("start", (~joined).cast("int")).withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.groupBy(*row, "run").agg(F.array_sort(F.collect_list(F.struct("x0", "box_id", "text", "x1"))).alias("p"))  # the spans of one number
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    good = (F.size("p") == 1) | text.rlike(r"^[-−]?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?%?$|^[-−]?[0-9]+(?:\.[0-9]+)?%?$")
    whole = F.struct(F.get("p", F.lit(0))["box_id"].alias("first_id"), text.alias("text"), F.get("p", F.lit(0))["x0"].alias("x0"), F.array_max(F.transform("p", lambda x: x["x1"])).alias("x1"), F.size("p").alias("parts"))
    apart = F.transform("p", lambda x: F.struct(x["box_id"].alias("first_id"), x["text"].alias("text"), x["x0"].alias("x0"), x["x1"].alias("x1"), F.lit(1).alias("parts")))
    return runs.select(*row, F.inline(F.when(good, F.array(whole)).otherwise(apart)))


def label_segments(text: Column, labels: list[str]) -> Column:
    """array<struct<label, content>>: the labels of a text in order and what follows each up to the next.

    Blanks may stand inside a label; where several begin at one place the longest counts.
    """
    spread = lambda label: r"\s*".join(F"[{c}]" if c in "()（）.*+?" else c for c in label)
    pattern = "|".join(spread(x) for x in sorted(labels, key=len, reverse=True))
    found, parts = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern)
    return F.zip_with(found, F.slice(parts, F.lit(2), F.greatest(F.size(found), F.lit(1))), lambda a, b: F.struct(F.regexp_replace(a, r"\s+", "").alias("label"), F.trim(b).alias("content")))


def centre_rows(boxes: DataFrame, page: list[str], least: float = 2.0, share: float = 0.55) -> DataFrame:
    """(page, box_id, row_no): boxes in rows by their centre lines, from the top.

    A box joins the nearest of the last three rows whose centre lies within `share` of the
    greater height (at least `least`), else opens one.  A fold over the boxes of one page.
    """
    kinds = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in [*page, "box_id"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(yc=(pdf["y0"] + pdf["y1"]) / 2, h=pdf["y1"] - pdf["y0"]).sort_values(["yc", "x0", "box_id"])
        rows: list[list[float]] = []  # top, bottom of each row
        number = []
        for y0, y1, yc, h in zip(pdf["y0"], pdf["y1"], pdf["yc"], pdf["h"], strict=True):
            near = [(abs(yc - (a + b) / 2), k) for k, (a, b) in list(enumerate(rows))[-3:] if abs(yc - (a + b) / 2) <= max(least, share * max(h, b - a))]
            if near:
                k = min(near)[1]
                rows[k] = [min(rows[k][0], y0), max(rows[k][1], y1)]
            else:
                k = len(rows)
                rows.append([y0, y1])
            number.append(k)
        return pdf.assign(row_no=number)[[*page, "box_id", "row_no"]]

    return boxes.groupBy(*page).applyInPandas(fold, f"{kinds}, row_no int")


def assign_columns(numbers: DataFrame, headers: DataFrame, row: list[str]) -> DataFrame:
    """(row, column_label, box_id): for each header from left to right the nearest number of the row that is still free; ties go left.

    numbers: row columns, box_id, x.  headers: the first of the row columns (their table), column_label, x.
    """
    listed = numbers.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("x", "box_id"))).alias("n"))
    heads = headers.groupBy(row[0]).agg(F.array_sort(F.collect_list(F.struct("x", "column_label"))).alias("h"))
    kind = numbers.schema["box_id"].dataType.simpleString()
    start = F.struct(F.col("n").alias("left"), F.array().cast(f"array<struct<column_label:string,box_id:{kind}>>").alias("pairs"))

    def step(state: Column, head: Column) -> Column:
        best = F.array_min(F.transform(state["left"], lambda t: F.struct(F.abs(t["x"] - head["x"]).alias("d"), t["x"].alias("x"), t["box_id"].alias("box_id"))))
        free = F.size(state["left"]) > 0
        return F.struct(
            F.when(free, F.filter(state["left"], lambda t: t["box_id"] != best["box_id"])).otherwise(state["left"]).alias("left"),
            F.when(free, F.array_append(state["pairs"], F.struct(head["column_label"].alias("column_label"), best["box_id"].alias("box_id")))).otherwise(state["pairs"]).alias("pairs"),
        )

    done = listed.join(heads, row[0]).withColumn("pairs", F.aggregate("h", start, step, lambda s: s["pairs"]))
    return done.select(*row, F.inline("pairs"))
