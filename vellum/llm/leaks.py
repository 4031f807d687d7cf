"""Held-out passages inside corpus documents, whole or in part, and not always letter for letter.

Letters and digits only, in one case and width, count.  A document is read once:
its q-grams are hashed as arrays, looked up among the q-grams of the items, and the hits
are counted in overlapping bands of diagonals.  By the q-gram lemma a stretch that keeps
to the edit budget leaves a known number of hits within one band; what falls short is
dropped.  The bands that remain are verified by banded alignment, in which other words
may stand for words but a figure has to be the same figure.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of the items of one pass (their index has some 30 bytes a letter); more are taken in further passes.
ITEM_LETTERS = 2_000_000
#: Letters of documents that are worked on at once in one task.
BLOCK_LETTERS = 1_000_000
#: Diagonals beside a band that an alignment may use.
SLACK = 8
#: Moves all diagonals above 0; longer documents than that are no text.
FAR = 1 << 40


@dataclass(frozen=True)
class Rule:
    """How much of an item makes a case, and the edit budget of such a stretch.

    Within `stretch` letters of the item up to `words` words of up to `word` letters may be
    exchanged for others of up to `word` letters, left out or put in; the stretch begins and
    ends with `edge` letters that are the same.
    """

    stretch: int
    q: int
    stride: int
    words: int
    word: int

    @property
    def hits(self) -> int:
        """Sampled q-grams that a stretch keeps, whatever is exchanged: the lemma's bound, less what sampling loses in each run."""
        left = self.stretch - self.q + 1 - self.words * (self.word + self.q - 1)
        return max(1, (left - (self.words + 1) * (self.stride - 1)) // self.stride)

    @property
    def shift(self) -> int:
        """Diagonals over which the hits of a stretch lie at most."""
        return self.words * self.word

    @property
    def half(self) -> int:
        """Bands are two of these wide and overlap by one, so hits that lie within `shift` diagonals share a band."""
        return self.shift + 1

    @property
    def edge(self) -> int:
        return self.word // 2

    @property
    def errors(self) -> int:
        """Letters that the budget exchanges, leaves out or puts in."""
        return self.words * self.word


RULES = {"zh": Rule(60, 8, 2, 2, 4), "en": Rule(150, 16, 4, 2, 10)}


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Code point -> its letter or digit in one case and width, 0 for everything else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        for c in unicodedata.normalize("NFKC", chr(cp)).casefold():
            if c.isalnum():
                table[cp] = ord(c)
                break
    return table


def _letters(text: str, table: np.ndarray) -> np.ndarray:
    points = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    return points[points > 0]


def _grams(letters: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams (q a power of two), by doubling."""
    h = letters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    base, size = 0xBF58476D1CE4E5B9, 1
    while size < q:
        if len(h) <= size:
            return np.zeros(0, dtype=np.uint64)
        h = h[:-size] * np.uint64(base) + h[size:]
        h ^= h >> np.uint64(31)
        base = base * base % 2**64 | 1
        size *= 2
    return h


class Index:
    """The q-grams of the items of one language group and how to find them."""

    def __init__(self, rule: Rule, ids: list, texts: list[np.ndarray]):
        self.rule, self.ids, self.texts = rule, ids, texts
        grams = [_grams(t, rule.q) for t in texts]
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat))
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.keys >> np.uint64(42)] = True

    def candidates(self, letters: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, band) with enough hits for a stretch within the edit budget.

        letters: all documents' letters in one array; doc: the document of each letter;
        start: the first letter of each document.
        """
        none = (np.zeros(0, np.int64),) * 3
        rule = self.rule
        if not len(self.keys) or len(letters) < rule.q:
            return none
        grams = _grams(letters, rule.q)
        at = np.arange(0, len(grams), rule.stride)
        at = at[self.bits[grams[at] >> np.uint64(42)]]
        at = at[doc[at] == doc[at + rule.q - 1]]
        k = np.searchsorted(self.keys, grams[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == grams[at]
        at, k = at[same], k[same]
        n = self.last[k] - self.first[k]
        if not len(at):
            return none
        posting = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        where = np.repeat(at, n)
        d, item, place = doc[where], self.item[posting].astype(np.int64), self.place[posting].astype(np.int64)
        # documents and items with too few hits in all can't have enough in a band
        pair = d * len(self.texts) + item
        order = np.argsort(pair, kind="stable")
        first = np.flatnonzero(np.diff(pair[order], prepend=-1))
        size = np.diff(np.append(first, len(order)))
        enough = order[np.repeat(size >= rule.hits, size)]
        if not len(enough):
            return none
        d, item, place, where = d[enough], item[enough], place[enough], where[enough]
        return self._bands(d, item, place, where - start[d] - place)

    def _bands(self, d: np.ndarray, item: np.ndarray, place: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        half = self.rule.half
        band = np.concatenate([(diagonal + FAR) // half, (diagonal + FAR) // half - 1])
        pair, place = np.tile(d * len(self.texts) + item, 2), np.tile(place, 2)
        order = np.lexsort((place, band, pair))
        pair, band, place = pair[order], band[order], place[order]
        # enough hits of one band within the letters of one stretch
        n = self.rule.hits
        last = slice(n - 1, None)
        begin = slice(None, len(pair) - n + 1)
        close = (pair[last] == pair[begin]) & (band[last] == band[begin]) & (place[last] - place[begin] <= self.rule.stretch - self.rule.q)
        pair, band = pair[begin][close], band[begin][close]
        new = np.append(True, (np.diff(pair) != 0) | (np.diff(band) != 0)) if len(pair) else np.zeros(0, bool)
        return pair[new] // len(self.texts), pair[new] % len(self.texts), band[new]

    def verify(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray, d: np.ndarray, item: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Which candidates align: in the band lies a stretch within the edit budget.

        The best local alignment decides where it spans the stretch; where it falls short by
        no more than exchanged words at its ends can make up, all stretches around it are
        aligned from end to end.
        """
        good = np.zeros(len(d), dtype=bool)
        rule = self.rule
        left = band * rule.half - FAR - SLACK
        width = 2 * rule.half + 2 * SLACK
        length = np.array([len(t) for t in self.texts])
        order = np.argsort(length[item], kind="stable")
        near: list[tuple[int, int, int]] = []
        for part in np.array_split(order, max(1, len(order) // 64)):
            if not len(part):
                continue
            first, last, score = self._align(letters, start[d[part]], end[d[part]], item[part], left[part], width)
            span = last - first
            good[part] = (span >= rule.stretch) & (score * rule.stretch >= (rule.stretch - 2 * rule.errors) * span)
            # the best local alignment scores no less than the stretch as a whole
            near += [(part[k], first[k], last[k]) for k in np.flatnonzero(~good[part] & (score >= rule.stretch - 2 * rule.errors))]
        for block in range(0, len(near), 64):
            c, first, last = (np.array(x) for x in zip(*near[block : block + 64], strict=True))
            good[c] = self._stretches(letters, start[d[c]], end[d[c]], item[c], left[c], width, first, last)
        return good

    def _stretches(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray, left: np.ndarray, width: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether some stretch of the item around [first, last) is in the document's band with no more errors than the budget's."""
        rule = self.rule
        far = 2 * (rule.word + rule.q)
        size = np.array([len(self.texts[i]) for i in item])
        low, high = np.maximum(0, last - rule.stretch - far), np.minimum(first + far, size - rule.stretch) + 1
        n = np.maximum(high - low, 0)
        own = np.repeat(np.arange(len(item)), n)
        if not len(own):
            return np.zeros(len(item), dtype=bool)
        begins = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        offset = np.cumsum(size) - size
        flat = np.concatenate([self.texts[i] for i in item]).astype(np.int64)
        base, begin, stop = (start + left)[own] + begins, start[own][:, None], end[own][:, None]
        column = np.arange(width)
        big = rule.stretch
        cell = np.zeros((len(own), width), dtype=np.int32)  # errors so far; the stretch may begin on any diagonal
        for i in range(rule.stretch):
            letter = flat[offset[own] + begins + i][:, None]
            place = (base + i)[:, None] + column[None, :]
            same = (place >= begin) & (place < stop) & (letters[np.clip(place, 0, len(letters) - 1)] == letter)
            if rule.edge <= i < rule.stretch - rule.edge:
                skipped = np.full_like(cell, big)
                skipped[:, :-1] = cell[:, 1:] + 1
                other = np.where((letter >= 48) & (letter <= 57), big, np.minimum(cell + 1, skipped))
                cell = np.where(same, np.minimum(cell, other), other)
                # letters put in between: along the row, each is an error
                cell = np.minimum.accumulate(cell - column, axis=1) + column
            else:
                cell = np.where(same, cell, big)
        found = (cell <= rule.errors).any(axis=1)
        return np.bincount(own, weights=found, minlength=len(item)) > 0

    def _align(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray, left: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, score) of the best local alignment of each candidate: letters of the item, and matches less errors."""
        rows = max(len(self.texts[i]) for i in item)
        text = np.zeros((len(item), rows), dtype=np.int64)
        for n, i in enumerate(item):
            text[n, : len(self.texts[i])] = self.texts[i]
        digit = (text >= 48) & (text <= 57)
        # A cell holds score * 2^20 + (2^20 - 1 - first letter of the item), so one maximum carries both.
        one, mask = 1 << 20, (1 << 20) - 1
        column = np.arange(width)
        fall = column * one
        cell = np.zeros((len(item), width), dtype=np.int64)
        best = np.zeros(len(item), dtype=np.int64)
        best_end = np.zeros(len(item), dtype=np.int64)
        base = start + left
        for i in range(rows):
            place = base[:, None] + (i + column)[None, :]
            inside = (place >= start[:, None]) & (place < end[:, None])
            other = letters[np.clip(place, 0, len(letters) - 1)]
            same = inside & (other == text[:, i : i + 1])
            fresh = mask - i
            # a letter of the item without partner: from the next diagonal of the row before
            skipped = np.empty_like(cell)
            skipped[:, :-1] = cell[:, 1:] - one
            skipped[:, -1] = 0
            free = np.maximum(cell - one, skipped)
            free[digit[:, i]] = 0
            cell = np.where(same, np.maximum(cell, fresh) + one, free)
            np.maximum(cell, 0, out=cell)
            # letters put in between: along the row, each costs one
            cell = np.maximum.accumulate(cell + fall, axis=1) - fall
            np.maximum(cell, 0, out=cell)
            top = cell.max(axis=1)
            better = (top >> 20) > (best >> 20)
            best = np.where(better, top, best)
            best_end = np.where(better, i + 1, best_end)
        return mask - (best & mask), best_end, best >> 20


def _search(indexes: list[Index], texts: list[str], table: np.ndarray) -> Iterator[tuple[int, object]]:
    each = [_letters(t, table) for t in texts]
    size = np.array([len(x) for x in each])
    end = np.cumsum(size)
    start = end - size
    letters = np.concatenate(each) if each else np.zeros(0, dtype=np.uint32)
    doc = np.repeat(np.arange(len(each)), size)
    for index in indexes:
        d, item, band = index.candidates(letters, doc, start)
        ok = index.verify(letters, start, end, d, item, band) if len(d) else np.zeros(0, dtype=bool)
        for x, y in sorted(set(zip(d[ok].tolist(), item[ok].tolist(), strict=True))):
            yield x, index.ids[y]


def _blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Row numbers of the texts, in blocks of bounded size; a longer text is a block of its own."""
    block, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if block and size + len(t) > BLOCK_LETTERS:
            yield block
            block, size = [], 0
        block.append(i)
        size += len(t)
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", rules: dict[str, Rule] = RULES, other: str = "en", item_letters: int = ITEM_LETTERS) -> DataFrame:
    """(doc_id, item_id): the documents that hold a stretch of an item's text.

    items: item_id, lang, text.  The items are a query set against all documents: they are
    read to the driver in blocks of about `item_letters` letters (by a hash of their rows)
    and sent to all executors, one pass over the documents a block, so what a pass holds has
    a bound in letters; a longer text is a block by itself.
    rules: by lang of the item; an unlisted or null lang takes the rule of `other`.
    Null and empty texts hold nothing; repeated rows count once; texts are read whole.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null and t <> ''")
    kind = {"d": rows.schema["doc_id"].dataType.simpleString(), "i": items.schema["item_id"].dataType.simpleString()}
    lang = F.when(F.col("lang").isin(*rules), F.col("lang")).otherwise(F.lit(other)).alias("lang")
    wanted = items.select("item_id", lang, "text").where("item_id is not null and text is not null").distinct()
    total = wanted.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // item_letters))
    table, result = letter_table(), None
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "lang", "text"), F.lit(blocks)) == b).collect()
        indexes = []
        for name, rule in rules.items():
            own = [(r["item_id"], _letters(r["text"], table)) for r in block if r["lang"] == name]
            own = [(i, t) for i, t in own if len(t) >= rule.stretch]
            indexes.append(Index(rule, [i for i, _ in own], [t for _, t in own]))
        sent = spark.sparkContext.broadcast((indexes, table))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            indexes, table = sent.value
            for batch in batches:
                ids, texts = batch["doc_id"].to_numpy(), batch["t"].tolist()
                hits = [(ids[part[x]], item) for part in _blocks(texts) for x, item in _search(indexes, [texts[i] for i in part], table)]
                yield pd.DataFrame({"doc_id": [h[0] for h in hits], "item_id": [h[1] for h in hits]})

        found = rows.mapInPandas(search, f"doc_id {kind['d']}, item_id {kind['i']}")
        result = found if result is None else result.unionByName(found)
    return result.distinct()
