"""Fill containers of fixed capacity with items, leaving as little space as possible.

Documents are measured in tokens of a public tokenizer.  Items are spread over groups
by a hash, each large enough to be packed well and small enough for one task.  Within
a group the dominance reduction of Martello and Toth fixes small sets that fill a
container at least as well as anything else could, over all sizes until none is left that
does, and the remainder goes by best fit, the largest item first.  A text above the capacity fills whole containers and leaves a
rest that is packed like any other item.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Where the public vocabularies lie; a parameter of every call.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Items of a group; more would take longer in one task, fewer would pack worse.
GROUP_ITEMS = 20_000

# Fixed value: the public pattern by which this vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text, taken whole; 0 for null and the empty text."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


class _Stock:
    """Sizes that are still there, with the searches the reduction needs (one count a size)."""

    def __init__(self, count: np.ndarray):
        self.count = count
        self.sizes = [int(x) for x in np.flatnonzero(count)]

    def left(self, size: int, gone: tuple[int, ...]) -> int:
        return int(self.count[size]) - gone.count(size)

    def largest(self, room: int, gone: tuple[int, ...]) -> int:
        """The largest size within the room, 0 if none."""
        i = bisect_right(self.sizes, room)
        while i:
            i -= 1
            if self.left(self.sizes[i], gone) > 0:
                return self.sizes[i]
        return 0

    def smallest(self, n: int, gone: tuple[int, ...], above: int = 0) -> list[int]:
        """The n smallest sizes above a bound, fewer if there are fewer."""
        out: list[int] = []
        for i in range(bisect_right(self.sizes, above), len(self.sizes)):
            size = self.sizes[i]
            out += [size] * min(n - len(out), max(self.left(size, gone), 0))
            if len(out) == n:
                break
        return out

    def take(self, sizes: tuple[int, ...]) -> None:
        for s in sizes:
            self.count[s] -= 1
            if self.count[s] == 0:
                self.sizes.pop(bisect_left(self.sizes, s))


def _dominating(stock: _Stock, top: int, capacity: int) -> tuple[int, ...] | None:
    """The set of at most three sizes with `top` that dominates every other feasible set with it, None if there is none.

    A set dominates another if the other's sizes can be parted among its sizes so that none is exceeded.
    """
    room, gone = capacity - top, (top,)
    one = stock.largest(room, gone)
    if not one:
        return gone
    small = stock.smallest(3, gone)
    if one == room or len(small) < 2 or small[0] + small[1] > room:
        return top, one  # nothing fills more than one, or no two fit
    if len(small) == 3 and sum(small) <= room:
        return None  # three fit: sets of four sizes aren't looked at
    best, high = 0, one
    while high and 2 * high > best:
        low = stock.largest(min(high, room - high), (top, high))
        best = max(best, high + low if low else 0)
        high = stock.largest(high - 1, gone)
    if one >= best:
        return top, one
    # {one, low} dominates a pair unless both of it exceed low
    low = stock.largest(room - one, (top, one))
    if low:
        above = stock.smallest(2, gone, above=low)
        if len(above) < 2 or above[0] + above[1] > room:
            return top, one, low
    return None


def reduce_sizes(count: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Martello-Toth reduction: the sets that are fixed; `count` (by size) keeps what is left.

    Every size is tried, the largest first, and all over again until no set dominates any
    more: what is fixed leaves less that can compete.  No optimal packing is lost.
    """
    stock, fixed = _Stock(count), []
    while True:
        before = len(fixed)
        for top in list(reversed(stock.sizes)):
            while stock.count[top] > 0 and (found := _dominating(stock, top, capacity)):
                stock.take(found)
                fixed.append(found)
        if len(fixed) == before:
            return fixed


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container of each item (from 0) and the number of containers; sizes are 0 to capacity."""
    container = np.full(len(sizes), -1, dtype=np.int64)
    if not len(sizes):
        return container, 0
    order = np.argsort(sizes, kind="stable")
    waiting: dict[int, list[int]] = {}
    for i in order[::-1]:
        waiting.setdefault(int(sizes[i]), []).append(int(i))
    count = np.bincount(sizes, minlength=capacity + 1)
    count[0] = 0
    used = 0
    rooms: dict[int, list[int]] = {}
    mask = 0
    for take in reduce_sizes(count, capacity):
        for s in take:
            container[waiting[s].pop()] = used
        room = capacity - sum(take)
        if room:
            rooms.setdefault(room, []).append(used)
            mask |= 1 << room
        used += 1
    for size in sorted(waiting, reverse=True):
        for i in waiting[size]:
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                at = rooms[room].pop()
                if not rooms[room]:
                    mask ^= 1 << room
            else:
                room, at, used = capacity, used, used + 1
            container[i] = at
            if room - size > 0 or size == 0:
                rooms.setdefault(room - size, []).append(at)
                mask |= 1 << (room - size)
    return container, used


def pack(documents: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, group_items: int = GROUP_ITEMS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's parts with their containers.

    Result: doc_id, part_no, container_id (text, unique over groups), first_token, tokens.
    A document is one part unless it has more than `capacity` tokens; then all parts but
    the last fill a container each.  A null or empty text is one part of 0 tokens, which
    lies in some container.  Repeated keys are packed as often as they come; documents
    with a null key too.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["k"], "tokens": [count_tokens(t, vocabulary) for t in batch["t"]]})

    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    groups = max(1, round(documents.count() / group_items))
    kind = rows.schema["k"].dataType.simpleString()
    sizes = rows.mapInPandas(measure, f"doc_id {kind}, tokens int")
    grouped = sizes.withColumn("group_no", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(groups)))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "doc_id"], kind="stable").reset_index(drop=True)
        total = group["tokens"].to_numpy(np.int64)
        whole = np.where(total > capacity, (total - 1) // capacity, 0)
        container, used = pack_sizes(total - whole * capacity, capacity)
        parts = whole + 1
        row = np.repeat(np.arange(len(group)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        last = part == whole[row]
        own = used + np.cumsum(~last) - 1
        at = np.where(last, container[row], own)
        number = str(int(group["group_no"].iloc[0]))
        return pd.DataFrame({
            "doc_id": group["doc_id"].to_numpy()[row], "part_no": part, "container_id": [f"{number}-{c}" for c in at],
            "first_token": part * capacity, "tokens": np.where(last, total[row] - part * capacity, capacity),
        })

    return grouped.groupBy("group_no").applyInPandas(fill, f"doc_id {kind}, part_no int, container_id string, first_token int, tokens int")


def containment(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, whole, fits): whether a document's parts follow one another from 0, and all its containers keep to the capacity."""
    load = packed.groupBy("container_id").agg(F.sum("tokens").alias("load"))
    each = packed.join(load, "container_id").groupBy("doc_id").agg(F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.sum("tokens").alias("tokens"), F.min("first_token").alias("begin"), F.max("load").alias("load"))
    return each.select("doc_id", ((F.col("begin") == 0) & (F.col("end") == F.col("tokens"))).alias("whole"), (F.col("load") <= capacity).alias("fits"))
