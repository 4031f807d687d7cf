"""Cut oversized items at natural boundaries by lexical cohesion.

A text over the limit is cut at ends of paragraphs or sentences.  Around every such
place the words before and after are compared; where the similarity of the two blocks
dips, the topic changes.  Within each window the deepest valley is taken, the next
piece repeats about `overlap` characters of the one before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.textforms import json_text
from vellum.runtime import cut

LIMIT, OVERLAP = 1200, 100
#: Characters on each side of a place that are compared, and the width of their hashed word counts.
BLOCK, WIDTH = 240, 128

_SENTENCE = re.compile(r"[。！？!?；;…]+[”’」』）)\"']*|\.(?=\s)[\"')]*\s?|\n+")
_WORD = re.compile(r"[A-Za-z]+|[0-9]+|[㐀-鿿]{1,2}")
_GAP = re.compile(r"[\s、，,：:；;。.)）]+")


def _valleys(text: str, places: np.ndarray) -> np.ndarray:
    """Depth of the similarity valley at each place: how far the blocks' cosine lies below the peaks beside it."""
    words = [(m.start(), zlib.crc32(m.group().lower().encode()) % WIDTH) for m in _WORD.finditer(text)]
    if not words or not len(places):
        return np.zeros(len(places))
    starts = np.array([w[0] for w in words])
    counts = np.zeros((len(words) + 1, WIDTH))
    counts[np.arange(1, len(words) + 1), [w[1] for w in words]] = 1
    np.cumsum(counts, axis=0, out=counts)
    at = lambda p: counts[np.searchsorted(starts, p)]
    middle = at(places)
    left, right = middle - at(np.maximum(places - BLOCK, 0)), at(places + BLOCK) - middle
    size = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    s = np.divide((left * right).sum(axis=1), size, out=np.zeros(len(places)), where=size > 0)
    depth = np.zeros(len(s))
    for i in range(len(s)):
        j = i
        while j > 0 and s[j - 1] >= s[j]:
            j -= 1
        k = i
        while k + 1 < len(s) and s[k + 1] >= s[k]:
            k += 1
        depth[i] = s[j] - s[i] + s[k] - s[i]
    return depth


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, in code points.

    Every piece has at most `limit` characters, the first starts at 0, the last ends at
    the end, and each next one starts before the end of the one before, by about
    `overlap` characters.  A text within the limit is one piece, an empty one too.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    ends = np.array(sorted({m.end() for m in _SENTENCE.finditer(text)}), dtype=np.int64)
    depth = _valleys(text, ends)
    paragraph = np.array([text[e - 1] == "\n" for e in ends], dtype=bool)
    pieces, start = [], 0
    while len(text) - start > limit:
        low, high = start + max(limit // 2, overlap + 1), start + limit
        a, b = np.searchsorted(ends, low), np.searchsorted(ends, high, side="right")
        if a < b:
            # paragraphs before sentences of the same depth, later places before earlier ones
            end = int(ends[max(range(a, b), key=lambda i: (round(depth[i], 6), paragraph[i], i))])
        elif (first := np.searchsorted(ends, start + overlap, side="right")) < a:
            end = int(ends[a - 1]) if ends[a - 1] > start + overlap else int(ends[first])
        else:
            gaps = [m.end() for m in _GAP.finditer(text, low, high)]
            end = gaps[-1] if gaps else high
        pieces.append((start, end))
        want = end - overlap
        near = [m.end() for m in _SENTENCE.finditer(text, max(start + 1, want - overlap // 2), min(end - 1, want + overlap // 2)) if m.end() < end]
        near = near or [m.end() for m in _GAP.finditer(text, max(start + 1, want - overlap // 4), min(end - 1, want + overlap // 4)) if m.end() < end]
        start = max(start + 1, min(near, key=lambda p: abs(p - want)) if near else want)
    pieces.append((start, len(text)))
    return pieces


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pieces of the chunks whose text is longer than `limit`: chunk columns, text, pieces array<struct<start, end>>."""
    long = chunks.withColumn("text", json_text(F.col("payload_json"))).where(F.char_length("text") > limit)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cuts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [{"start": a, "end": b} for a, b in cut_text(t, limit)])

    return long.withColumn("pieces", cuts("text"))


def rechunk(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All chunks as pieces of at most `limit` characters, renumbered within their document.

    chunks: chunk_id, document_id, chunk_index, payload_json.  Result: chunk_id, piece_no,
    document_id, chunk_index (new, from 0, in the order of the old index and chunk_id;
    unknown old indexes first, in parts by a hash), document_length (characters of the piece), piece_start,
    piece_end, piece_text.  Repeated rows count once; a chunk whose payload is null, no
    object or without a text has no piece.  Null documents are numbered as one document.
    """
    rows = chunks.select("chunk_id", "document_id", "chunk_index", json_text(F.col("payload_json")).alias("text")).where("text is not null")
    rows = rows.withColumn("row_key", F.sha2(F.to_json(F.struct("chunk_id", "document_id", "chunk_index", "text")), 256)).dropDuplicates(["row_key"])

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cuts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in cut_text(t, limit)])

    long = F.char_length("text") > limit
    one = F.array(F.struct(F.lit(0).alias("start"), F.char_length("text").alias("end")))
    # kept, so that a text is cut once however often its pieces are looked at
    pieces = cut(rows.withColumn("cut", cuts(F.when(long, F.col("text")))).withColumn("cut", F.when(long, F.col("cut")).otherwise(one)))
    # Two levels of numbering, so that a document that holds a third of all chunks is no single task.
    narrow = pieces.select("row_key", "chunk_id", "document_id", F.coalesce("chunk_index", F.lit(-1)).alias("i"), F.size("cut").alias("n"))
    narrow = narrow.withColumn("block", F.floor(F.col("i") / 512))
    narrow = narrow.withColumn("block", F.when(F.col("i") < 0, F.pmod(F.xxhash64("row_key"), F.lit(64)) - 64).otherwise(F.col("block")))  # unknown indexes, however many, in parts
    blocks = narrow.groupBy("document_id", "block").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("document_id").alias("d"), F.col("block").alias("k"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("document_id", "block").orderBy("i", "chunk_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        narrow.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(blocks, F.col("document_id").eqNullSafe(F.col("d")) & (F.col("block") == F.col("k")))
        .select("row_key", (F.col("base") + F.col("within")).alias("offset"))
    )
    out = pieces.join(offsets, "row_key").select("chunk_id", "document_id", "offset", "text", F.posexplode("cut").alias("piece_no", "p"))
    return out.select(
        "chunk_id", "piece_no", "document_id", (F.col("offset") + F.col("piece_no")).cast("int").alias("chunk_index"), (F.col("p.end") - F.col("p.start")).alias("document_length"),
        F.col("p.start").alias("piece_start"), F.col("p.end").alias("piece_end"), F.substr(F.col("text"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("piece_text"),
    )


def found(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(chunk_id): the chunks that the operator cuts into more than one piece."""
    return oversized(chunks, limit).where(F.size("pieces") > 1).select("chunk_id").where("chunk_id is not null").distinct()


def coverage(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, characters, within, gapless): whether a chunk's pieces keep the limit, and cover it with overlaps of about the right size."""
    w = Window.partitionBy("chunk_id").orderBy("piece_no")
    shared = F.lag("piece_end").over(w) - F.col("piece_start")
    each = pieces.withColumn("fits", F.when(F.col("piece_no") == 0, F.col("piece_start") == 0).otherwise((shared > overlap // 3) & (shared < 2 * overlap)))
    return each.groupBy("chunk_id").agg(F.max("piece_end").alias("characters"), (F.max("document_length") <= limit).alias("within"), F.min("fits").alias("gapless"))
