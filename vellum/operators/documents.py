"""Pages, lines and chunks of documents: routes, quality, repeated furniture, headings, packing, reports."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T


def route(chars: Column, images: Column, image_ratio: Column, suspicious: Column, duplicated: Column) -> Column:
    """How a page is to be read, from what its native text shows: the first rule that holds."""
    return (
        F.when((chars == 0) & (images > 0), "full_ocr").when(chars == 0, "manual_review")
        .when((suspicious > 0.02) & (image_ratio >= 0.65), "full_ocr").when(suspicious > 0.02, "manual_review")
        .when(duplicated > 0.5, "manual_review")
        .when((images > 0) & (image_ratio >= 0.65) & (chars < 100), "partial_ocr").when((images > 0) & (chars < 20), "partial_ocr").otherwise("native")
    )


def suspicious_share(text: Column) -> Column:
    """Share of control, private-use and replacement characters among those that are no blanks."""
    compact = F.regexp_replace(text, r"\s+", "")
    return F.coalesce(F.try_divide(F.regexp_count(compact, F.lit(r"[\p{Cc}\p{Co}\x{FFFD}]")), F.char_length(compact)), F.lit(0.0))


def lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, document_id, page_start, line_no, line) of all chunks, blank lines left out."""
    cut = chunks.select("chunk_id", "document_id", "page_start", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return cut.where(F.trim("line") != "").select("chunk_id", "document_id", "page_start", (F.col("i") + 1).alias("line_no"), "line")


def repeated_lines(chunks: DataFrame, share: float = 0.2, least: int = 3) -> DataFrame:
    """(document_id, key, pages): short lines that repeat on many pages of their document, numbers aside."""
    keyed = lines(chunks).where(F.char_length("line") <= 160).withColumn("key", T.repeated_key(F.col("line"))).where("key <> ''")
    total = chunks.groupBy("document_id").agg(F.countDistinct("page_start").alias("total"))
    seen = keyed.groupBy("document_id", "key").agg(F.countDistinct("page_start").alias("pages"))
    return seen.join(total, "document_id").where(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("total") * share))).select("document_id", "key", "pages")


def duplicate_share(chunks: DataFrame) -> DataFrame:
    """(chunk_id, duplicate_share): share of a chunk's characters in lines that it repeats."""
    keyed = lines(chunks).withColumn("key", F.regexp_replace("line", T.BLANK, "")).where("key <> ''").groupBy("chunk_id", "key").agg(F.count("*").alias("n"))
    size = F.char_length("key")
    return keyed.groupBy("chunk_id").agg(F.round(F.least(F.sum((F.col("n") - 1) * size) / F.sum(F.col("n") * size), F.lit(1.0)), 6).alias("duplicate_share"))


def chunk_report(chunks: DataFrame, least: int = 100, most: int = 650) -> DataFrame:
    """One row a document: chunks, tokens (smallest, 50th and 95th per cent by exact order, largest), pages crossed, sections."""
    rows = chunks.select("document_id", T.token_estimate(F.col("text")).alias("n"), (F.col("page_start") != F.col("page_end")).alias("crosses"), (F.size("section_path") > 0).alias("sectioned"))
    # equal sizes are counted first, so a document's list is as long as its sizes differ
    sizes = rows.groupBy("document_id", "n").agg(F.count("*").alias("c"), F.count_if("crosses").alias("crossing"), F.count_if("sectioned").alias("sectioned"))
    w = Window.partitionBy("document_id").orderBy("n")
    total = F.sum("c").over(Window.partitionBy("document_id"))
    placed = sizes.withColumn("upto", F.sum("c").over(w)).withColumn("total", total)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("n")))
    return placed.groupBy("document_id").agg(
        F.sum("c").alias("chunks"), F.coalesce(F.sum(F.when(F.col("n") < least, F.col("c"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(F.col("n") > most, F.col("c"))), F.lit(0)).alias("above"), F.sum("crossing").alias("crossing"), F.sum("sectioned").alias("sectioned"),
        F.min("n").alias("token_min"), at(F.least(F.floor(F.col("total") / 2), F.col("total") - 1)).alias("token_p50"), at(F.ceil(F.col("total") * 0.95) - 1).alias("token_p95"), F.max("n").alias("token_max"),
    )


@dataclass(frozen=True)
class Budget:
    """Token budget of packed chunks."""

    target: int = 450
    most: int = 650
    least: int = 100
    overlap: int = 60


def pack_spans(tokens: np.ndarray, heads: np.ndarray, budget: Budget = Budget()) -> list[tuple[int, int]]:
    """(first, end) of the packed groups of a document's units, over prefix sums of their tokens.

    From a group's first unit three places are looked up: where the target is reached, where
    one more unit would exceed the most, and the next heading once the least is reached; the
    nearest ends it.  The next group repeats the units before it up to the overlap, back to
    the last heading at most; before a heading, or where they leave no room, none.
    """
    total = np.append(0, np.cumsum(tokens))
    marks = np.flatnonzero(heads)
    n, spans, first, fresh = len(tokens), [], 0, 0
    while fresh < n:
        base = total[first]
        full = np.searchsorted(total, base + budget.target)
        over = np.searchsorted(total[1:], base + budget.most, side="right")
        ready = np.searchsorted(total, base + budget.least)
        head = np.searchsorted(marks, max(ready, fresh + 1))
        end = max(fresh + 1, min(full, over, marks[head] if head < len(marks) else n, n))
        spans.append((first, int(end)))
        if end >= n:
            break
        first = fresh = int(end)
        if not heads[end]:
            before = np.searchsorted(marks, end)
            back = max(np.searchsorted(total, total[end] - budget.overlap), marks[before - 1] + 1 if before else 0, spans[-1][0])
            if total[end + 1] - total[back] <= budget.most:
                first = int(back)
    return spans


def pack_documents(units: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(document_id, chunk_index, unit_from, unit_to, tokens): units of each document packed to the budget.

    units: document_id, unit_no, unit, in the order of unit_no.  Only two numbers a unit are
    gathered for a document; the texts stay where they are.
    """
    rows = units.select("document_id", "unit_no", T.token_estimate(F.col("unit")).alias("tokens"), T.heading_level(F.col("unit")).isNotNull().alias("head"))
    kind = units.schema["document_id"].dataType.simpleString()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("unit_no", kind="stable")
        tokens, numbers = group["tokens"].to_numpy(np.int64), group["unit_no"].to_numpy()
        spans = pack_spans(tokens, group["head"].to_numpy(bool), budget)
        out = [(group["document_id"].iloc[0], k, numbers[a], numbers[b - 1], int(tokens[a:b].sum())) for k, (a, b) in enumerate(spans)]
        return pd.DataFrame(out, columns=["document_id", "chunk_index", "unit_from", "unit_to", "tokens"])

    return rows.groupBy("document_id").applyInPandas(pack, f"document_id {kind}, chunk_index int, unit_from int, unit_to int, tokens int")


def packed_texts(units: DataFrame, packed: DataFrame) -> DataFrame:
    """(document_id, chunk_index, text, digest, page_start, page_end, units) of packed groups.

    units: document_id, unit_no, unit, page.  The units join the groups by document and number.
    """
    wanted = packed.select("document_id", "chunk_index", F.explode(F.sequence("unit_from", "unit_to")).alias("unit_no"))
    joined = wanted.join(units.select("document_id", "unit_no", "unit", "page"), ["document_id", "unit_no"])
    # a group holds at most the budget's tokens, so its list is short
    listed = joined.groupBy("document_id", "chunk_index").agg(F.sort_array(F.collect_list(F.struct("unit_no", "unit"))).alias("u"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    text = F.array_join(F.transform("u", lambda x: x["unit"]), "\n")
    return listed.select("document_id", "chunk_index", text.alias("text"), F.sha2(text, 256).alias("digest"), "page_start", "page_end", F.size("u").alias("units"))


def section_stack(units: DataFrame) -> DataFrame:
    """(document_id, unit_no, section): the headings above each unit, outermost first, by one window a level.

    A heading of some level ends all headings of the same and deeper levels.
    """
    rows = units.select("document_id", "unit_no", F.trim("unit").alias("unit"), T.heading_level(F.col("unit")).alias("level"))
    w = Window.partitionBy("document_id").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("unit_no", "unit")), ignorenulls=True).over(w) for k in range(1, 5)}
    rows = rows.withColumns({f"l{k}": c for k, c in last.items()})
    stack = []
    for k in range(1, 5):
        shallower = [F.coalesce(F.col(f"l{j}.unit_no"), F.lit(-1)) for j in range(1, k)]
        live = F.col(f"l{k}").isNotNull() & (F.col(f"l{k}.unit_no") > (F.greatest(*shallower, F.lit(-1)) if shallower else F.lit(-1)))
        stack.append(F.when(live, F.col(f"l{k}.unit")))
    return rows.select("document_id", "unit_no", F.array_join(F.array_compact(F.array(*stack)), " > ").alias("section"))
