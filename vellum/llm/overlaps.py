"""The same or nearly the same records across splits.

Records are brought to a canonical form, the forms are hashed, the hashes of evaluation
records are joined with those of training records, and the matches are counted by split
and source.  The form levels case, punctuation, blanks and letter width.  What else counts
as a light edit is learnt from all records: neighbouring forms with the same numbers that
differ in one short span show which spans are put in or exchanged in many places, and an
edit that explains a fair share of all occurrences of its rarer side is undone.  Spans that
tell records apart (names, measures) are exchanged for many different others, each rarely,
and stay.  The order of the words is kept throughout.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from vellum.llm.textforms import half_width
from vellum.runtime import cut

#: Tokens of a span that an edit may put in or exchange.
SPAN = 3
#: Neighbours on either side in the order of forms that a form is compared with.
NEIGHBOURS = 2
#: Different places that have to show an edit, at least and as a share of all forms; so there are at most
#: 16 * NEIGHBOURS / LEAST_SHARE edits, whatever the data.
LEAST_PLACES, LEAST_SHARE = 3, 1 / 20_000
#: Share of the occurrences of an edit's rarer side that the places must make up.  For a token put in, the rarer
#: side is the forms with it or those without it.
LIGHT_EXCHANGE, LIGHT_PUT_IN = 0.005, 0.02
#: The same in some surroundings only, which are rare by themselves.
AROUND = 0.15
#: Share of all exchanges of the rarer side that go to its partner: what tells records apart has many partners.
PARTNER = 1 / 3
#: A word is taken for a misspelling if it is one letter away from one that is so many times as frequent and
#: stands in at least this share of the forms.
SPELLING_RATIO, COMMON_SHARE = 10, 0.005
#: Rounds of learning; a later round sees the forms without the edits of the earlier ones.
ROUNDS = 1
#: Ids that one row of an audit lists at most; a unit with more has several rows.
UNIT_IDS = 10_000

Edits = dict[str, str]


def base_form(text: Column) -> Column:
    """Latin words, numbers and single other characters in order, parted by blanks: one case and width, no punctuation."""
    bare = F.regexp_replace(F.lower(half_width(text)), r"[\p{P}\p{S}]", " ")
    return F.array_join(F.regexp_extract_all(bare, F.lit(r"[a-z]+|[0-9]+|[^\sa-z0-9]"), F.lit(0)), " ")


def _place(*parts: list[str]) -> int:
    name = "\x1f".join(" ".join(p) for p in parts).encode("utf-8", "surrogatepass")
    return zlib.crc32(name) << 31 ^ zlib.crc32(name[::-1])


def compare_forms(a: list[str], b: list[str]) -> list[tuple[str, str, str, str, int]]:
    """(span, other span, the same in surroundings, place) of the one edit between two forms, the smaller span first.

    The edit is given alone and in its surroundings ('^' and '$' at the ends), as it may be light in
    some of them only: a token put in with the tokens on both sides, an exchange with either or both.
    Empty if the forms differ in more than one edit.
    """
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if len(x) > SPAN or len(y) > SPAN:
        # the same token put in at several places
        more = Counter(a) - Counter(b) or Counter(b) - Counter(a)
        if len(more) != 1:
            return []
        token = next(iter(more))
        rest = [t for t in a if t != token]
        if token.isdigit() or rest != [t for t in b if t != token] or (token in a and token in b):
            return []
        return [("", token, "", token, _place(rest))]
    digits = [any(t.isdigit() for t in side) for side in (x, y)]
    if not x and not y or all(digits) or (any(digits) and not (x and y)) or sorted(x) == sorted(y):
        return []  # figures are never exchanged for one another, nor words for the same in another order
    x, y = sorted((x, y), key=" ".join)
    left, right = ([a[i - 1]] if i else ["^"]), ([a[len(a) - j]] if j else ["$"])
    place, own = _place(a[:i], a[len(a) - j :]), (" ".join(x), " ".join(y))
    around = [([], [])] + ([(left, []), ([], right), (left, right)] if x else [(left, right)] if len(y) == 1 else [])
    return [(*own, " ".join(l + x + r), " ".join(l + y + r), place) for l, r in around if not any(t.isdigit() for t in l + r)]


def _shown_edits(forms: DataFrame) -> DataFrame:
    """(bare_x, bare_y, x, y, places): edits between forms that are neighbours by their beginning or their end and have the same numbers.

    The forms are sorted over all partitions (range partitioning, so no group is gathered
    however many forms share their numbers) and each is compared with the next few.
    """
    tokens = F.split("form", " ")
    numbers = F.array_join(F.filter(tokens, lambda t: t.rlike("^[0-9]{2,}$")), " ")  # a single digit may stand for a word

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list[tuple[str, list[str]]] = []
        for batch in batches:
            out = []
            for number, form in zip(batch["numbers"], batch["form"], strict=True):
                own = form.split(" ")
                out += [e for n, other in last if n == number for e in compare_forms(other, own)]
                last = [*last[1 - NEIGHBOURS :], (number, own)] if NEIGHBOURS > 1 else [(number, own)]
            if out:
                yield pd.DataFrame(out, columns=["bare_x", "bare_y", "x", "y", "place"])

    shown = None
    for order in (F.col("form"), F.array_join(F.reverse(tokens), " ")):
        ranged = forms.select(numbers.alias("numbers"), order.alias("order"), "form").repartitionByRange("numbers", "order").sortWithinPartitions("numbers", "order")
        one = ranged.select("numbers", "form").mapInPandas(look, "bare_x string, bare_y string, x string, y string, place long")
        shown = one if shown is None else shown.unionByName(one)
    return shown.distinct().groupBy("bare_x", "bare_y", "x", "y").agg(F.count("*").alias("places"))


def _latin(span: str) -> bool:
    return bool(re.match("[a-z]", span))


def _one_letter_apart(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def learn_edits(forms: DataFrame) -> Edits:
    """span -> what to write for it (the empty string: leave it out), from distinct forms (a column `form`, cut)."""
    script = forms.agg(F.count("*").alias("n"), F.count_if(F.col("form").rlike("[a-z]")).alias("latin")).first()
    total = script["n"]
    if not total:
        return {}
    least = max(LEAST_PLACES, math.ceil(total * LEAST_SHARE))
    shown = cut(_shown_edits(forms))
    frequent = forms.select(F.explode(F.array_distinct(F.split("form", " "))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    common = {r["t"]: r["n"] for r in frequent.where((F.col("n") >= total * COMMON_SHARE) & ~F.col("t").rlike("^[0-9]+$")).collect()}  # at most (tokens of a form) / COMMON_SHARE words
    spelled = (F.col("x") == F.col("bare_x")) & F.col("x").rlike("^[a-z]{6,}$") & F.col("y").rlike("^[a-z]{6,}$") & (F.levenshtein("x", "y") <= 2) & (F.col("x").isin(*common) | F.col("y").isin(*common))
    edits = shown.where((F.col("places") >= least) | spelled).collect()  # bounded by LEAST_SHARE, and by the forms one letter from a common word
    if not edits:
        return {}
    spans = {s for r in edits for s in (r["x"], r["y"]) if s}
    by_first: dict[str, list[list[str]]] = {}
    for span in sorted(spans):
        by_first.setdefault(span.split(" ")[0], []).append(span.split(" "))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for form in batch["form"]:
                t = ["^", *form.split(" "), "$"]
                found.update({" ".join(s) for i, first in enumerate(t) if first in by_first for s in by_first[first] if t[i : i + len(s)] == s})
        if found:
            yield pd.DataFrame({"span": list(found), "n": list(found.values())})

    often = {r["span"]: r["n"] for r in forms.mapInPandas(count, "span string, n long").groupBy("span").agg(F.sum("n").alias("n")).collect()}  # one row a span of the edits
    scripts = {True: script["latin"], False: total - script["latin"]}
    both = shown.where((F.col("x") == F.col("bare_x")) & (F.col("x") != "")).select("places", F.explode(F.array("x", "y")).alias("span"))
    partners = {r["span"]: r["n"] for r in both.groupBy("span").agg(F.sum("places").alias("n")).join(F.broadcast(forms.sparkSession.createDataFrame([(s,) for s in spans], "span string")), "span").collect()}  # the spans of the edits

    def light(r: Row) -> tuple[str, str, float]:
        """(rarer side, other side, share of the rarer side's occurrences that the places make up; 0 if they are too few)."""
        x, y = r["x"], r["y"]
        rare, other = sorted((x, y), key=lambda s: (often.get(s, 0), s)) if x else (y, "")
        base = often.get(rare, 0) if x else min(often.get(y, 0), scripts[_latin(y)] - often.get(y, 0))
        return rare, other, r["places"] / max(base, 1) if r["places"] >= least else 0.0

    best: dict[str, tuple[int, str]] = {}
    known: set[tuple[str, str]] = set()
    for r in edits:
        if r["x"] == r["bare_x"]:
            rare, other, share = light(r)
            misspelt = _one_letter_apart(rare, other) and min(len(rare), len(other)) >= 6 and other in common and often.get(other, 0) >= SPELLING_RATIO * often.get(rare, 0)
            if share >= (LIGHT_EXCHANGE if r["x"] else LIGHT_PUT_IN) and (not r["x"] or r["places"] >= PARTNER * partners[rare]) or misspelt:
                known.add((r["bare_x"], r["bare_y"]))
                if rare not in best or (r["places"], other) > best[rare]:
                    best[rare] = (r["places"], other)
    inside: dict[str, tuple[int, str]] = {}
    for r in edits:
        bare = (r["bare_x"], r["bare_y"])
        if r["x"] == bare[0] or (bare[0] != "") != (bare in known):
            continue  # in surroundings count exchanges that are light and tokens put in that are not light everywhere
        rare, other, share = light(r)
        # an exchange only where its rarer side has another partner elsewhere
        second = next((s for s in bare if s in best and best[s][1] not in bare), None)
        if share >= AROUND and (not bare[0] or second is not None) and (rare not in inside or (r["places"], other) > inside[rare]):
            inside[rare] = (r["places"], other)
    return {rare: other for rare, (_, other) in (inside | best).items()}


def apply_edits(forms: pd.Series, edits: Edits) -> pd.Series:
    """The forms with all edits undone, longer spans first, until nothing changes (a few rounds at most)."""
    if not edits:
        return forms
    pattern = re.compile("(?<= )(?:" + "|".join(re.escape(s) for s in sorted(edits, key=lambda s: (-len(s), s))) + ")(?= )")

    def undo(form: str | None) -> str | None:
        if form is None:
            return None
        text = f" ^ {form} $ "
        for _ in range(8):
            new = re.sub(" +", " ", pattern.sub(lambda m: edits[m.group()], text))
            if new == text:
                break
            text = new
        return text.replace("^", "").replace("$", "").strip()

    return forms.map(undo)


def _undone(rows: DataFrame, column: str, edits: Edits) -> DataFrame:
    @F.pandas_udf("string")
    def undo(forms: pd.Series) -> pd.Series:
        return apply_edits(forms, edits)

    return rows.withColumn(column, undo(column))


def canonical_records(records: DataFrame, text: str, *, rounds: int = ROUNDS) -> DataFrame:
    """Adds canon: the canonical form as one string, and canon_hash; both null where the text is null or holds nothing.

    rounds=0 levels case, punctuation, blanks and width only.
    """
    rows = records.withColumn("canon", base_form(F.col(text)))
    for _ in range(rounds):
        edits = learn_edits(cut(rows.where("canon <> ''").select(F.col("canon").alias("form")).distinct()))
        if not edits:
            break
        rows = cut(_undone(rows, "canon", edits))
    return rows.withColumn("canon", F.when(F.col("canon") != "", F.col("canon"))).withColumn("canon_hash", F.when(F.col("canon").isNotNull(), F.xxhash64("canon")))


def canonical_cases(cases: DataFrame, training: list[str], evaluation: list[str], *, key: str = "case_id", text: str = "query", split: str = "split", source: str = "source", rounds: int = ROUNDS) -> DataFrame:
    """(id, split, source, trained, canon, canon_hash) of the records of both sides.

    Exactly repeated rows count once; null or empty texts, null keys and other splits give
    no row.  trained: whether the record is one of the training side.
    """
    rows = cases.select(F.col(key).alias("id"), F.col(split).alias("split"), F.col(source).alias("source"), F.col(text).alias("text")).where("id is not null and text is not null").where(F.col("split").isin(*training, *evaluation)).distinct()
    canon = canonical_records(rows.select("id", "split", "source", base_form(F.col("text")).alias("base")), "base", rounds=rounds)
    return cut(canon.where("canon_hash is not null").select("id", "split", "source", F.col("split").isin(*training).alias("trained"), "canon", "canon_hash"))


def cross_split_pairs(canon: DataFrame) -> DataFrame:
    """Pairs of records, one of a training and one of an evaluation split, with the same canonical form.

    Columns: train_id, train_split, train_source, eval_id, eval_split, eval_source,
    canon_hash.  The hash finds the partners, the canonical form itself decides.
    """
    side = lambda trained, p: canon.where(F.col("trained") == trained).select("canon_hash", "canon", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "split", "source")])
    return side(True, "train").join(side(False, "eval"), ["canon_hash", "canon"]).drop("canon").distinct()


def overlapping_pairs(pairs: DataFrame) -> DataFrame:
    """(case_id_a, case_id_b), the smaller id first."""
    low, high = F.least("train_id", "eval_id"), F.greatest("train_id", "eval_id")
    return pairs.where(low != high).select(low.alias("case_id_a"), high.alias("case_id_b")).distinct()


def _shared(canon: DataFrame) -> DataFrame:
    """(canon_hash, canon, trained_n, tested_n): the forms that stand on both sides, counted before they are shuffled."""
    g = canon.select("canon_hash", "canon", "id", "trained").distinct().groupBy("canon_hash", "canon").agg(F.count_if("trained").alias("trained_n"), F.count_if(~F.col("trained")).alias("tested_n"))
    return g.where("trained_n > 0 and tested_n > 0")


def overlap_units(canon: DataFrame) -> DataFrame:
    """One row for each canonical form that stands on both sides: unit_id, splits and query_ids, in the form of an audit.

    A form of more than UNIT_IDS records has several rows, each with a part of the ids and all splits.
    """
    both = canon.join(_shared(canon), ["canon_hash", "canon"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil((F.col("trained_n") + F.col("tested_n")) / UNIT_IDS)))
    splits = both.groupBy("canon_hash", "canon").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    units = both.groupBy("canon_hash", "canon", "part").agg(F.sort_array(F.collect_set("id")).alias("query_ids"))
    name = F.concat(F.lit("overlap-"), F.lower(F.hex("canon_hash")), F.when(F.col("part") > 0, F.concat(F.lit("-"), F.col("part"))).otherwise(""))
    return units.join(splits, ["canon_hash", "canon"]).select(name.alias("unit_id"), "splits", "query_ids")


def overlap_counts(canon: DataFrame) -> DataFrame:
    """(eval_split, eval_source, leaked, pairs): evaluation records with a partner in training, and their pairs.

    Pairs are counted from the number of training records of each form, not listed.
    """
    tested = canon.where(~F.col("trained")).select("id", F.col("split").alias("eval_split"), F.col("source").alias("eval_source"), "canon_hash", "canon").distinct()
    return tested.join(_shared(canon), ["canon_hash", "canon"]).groupBy("eval_split", "eval_source").agg(F.countDistinct("id").alias("leaked"), F.sum("trained_n").alias("pairs"))
