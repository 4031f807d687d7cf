"""One consistent form for text that looks the same but differs in its characters.

Distinct texts are exploded to positioned code points, mapped by broadcast joins
(compatibility decomposition, then look-alike letters), their combining marks are
ordered by combining class, composed again and the strings rebuilt.  Only distinct
texts that hold something outside printable ASCII take that way, so the shuffle
carries each spelling once, however often it is repeated.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.runtime import bounded_broadcast, cut

# Letters, marks and signs of other scripts that are drawn like the
# prototype on the left; compatibility characters are not listed, as Unicode's own
# decomposition covers them.
LOOK_ALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ",
    "K": "КΚ", "L": "Ꮮ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏ", "T": "ТΤ",
    "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "аɑ", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "јϳ", "k": "к", "l": "ӏ",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "β": "ꞵßϐ", "α": "⍺", "·": "∙•・⋅‧･", "-": "‐‑‒–—−﹣－⁃", "'": "ʼ’‘′`´ʹ", '"': "“”″", ",": "‚", "%": "٪", "/": "⁄∕", ":": "：∶",
    "长": "⻓", "门": "⻔", "马": "⻢", "鱼": "⻥", "鸟": "⻦", "麦": "⻨", "黄": "⻩", "齐": "⻬", "齿": "⻮", "龙": "⻰", "龟": "⻳", "见": "⻅", "贝": "⻉", "车": "⻋", "页": "⻚", "风": "⻛", "飞": "⻜", "食": "⻝", "民": "⺠",
}

#: What a figure may consist of once its signs are plain.
PLAIN_FIGURE = r"^[0-9,.%()\-+]+\z"
_PLAIN, _RAGGED = r"^[!-~ ]+\z", r"^ | \z|  "


def _unseen(c: str) -> bool:
    """Format characters, variation selectors, joiners and controls leave no mark on the page."""
    cp = ord(c)
    return unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r\v\f\x85" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2800)


def _blank(c: str) -> bool:
    return c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp")


@lru_cache(1)
def _tables() -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, list[tuple[str, str]]]:
    """Decompositions, look-alikes, combining classes and primary compositions, from the Unicode data of Python."""
    decompositions, classes, pairs = [], [], []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:  # Hangul syllables stay composed
            continue
        c = chr(cp)
        if _unseen(c):
            decompositions.append((c, ""))
        elif _blank(c):
            if c != " ":
                decompositions.append((c, " "))
        else:
            d = unicodedata.normalize("NFKD", c)
            if d != c:
                # spacing accents decompose to a blank and a mark: their own glyph is kept
                d = c if d[0] == " " and len(d) > 1 else "".join(" " if _blank(x) else x for x in d if not _unseen(x))
                if d != c:
                    decompositions.append((c, d))
            n = unicodedata.combining(c)
            if n:
                classes.append((c, n))
            one = unicodedata.decomposition(c)
            if one and one[0] != "<" and " " in one and unicodedata.normalize("NFC", c) == c:
                pairs.append(("".join(chr(int(x, 16)) for x in one.split()), c))
    look = [(x, to) for to, group in LOOK_ALIKES.items() for x in group]
    return (
        pd.DataFrame(decompositions, columns=["c", "d"]),
        pd.DataFrame(look, columns=["d1", "l"]),
        pd.DataFrame(classes, columns=["d1", "ccc"]),
        pairs,
    )


def unify_texts(texts: DataFrame, column: str) -> DataFrame:
    """The distinct non-null texts of `column` as (text, plain).

    plain: without unseen characters, compatibility forms and look-alike letters
    replaced by their prototypes, canonical composition, blanks squeezed to single
    spaces and none at either end.  An empty text, or one of unseen characters only,
    becomes the empty string.  Texts of any length are taken whole; two texts that
    look the same get the same plain.  An empty table gives an empty table.
    """
    spark = texts.sparkSession
    decompositions, look, classes, pairs = _tables()
    # the three tables follow from the Unicode version: fewer than 25,000 rows, whatever the data
    dec, alike, marks = (F.broadcast(spark.createDataFrame(t)) for t in (decompositions, look, classes))
    distinct = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
    plain_already = F.col("text").rlike(_PLAIN) & ~F.col("text").rlike(_RAGGED)
    ascii_only = distinct.where(plain_already).select("text", F.col("text").alias("plain"))
    # a long text is known by its hash while it lies in pieces, so that no row carries it
    name = F.when(F.char_length("text") <= 64, F.col("text")).otherwise(F.concat(F.lit("\x00"), F.sha2("text", 256)))
    odd = distinct.where(~plain_already).withColumn("name", name)
    points = odd.select("name", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)."), F.lit(0))).alias("pos", "c"))
    parts = (
        points.join(dec, "c", "left")
        .withColumn("d", F.coalesce("d", "c"))
        .select("name", "pos", F.posexplode(F.regexp_extract_all("d", F.lit(r"(?s)."), F.lit(0))).alias("sub", "d1"))
        .join(alike, "d1", "left")
        .withColumn("d1", F.coalesce("l", "d1"))
        .join(marks, "d1", "left")
        .select("name", F.struct("pos", "sub", F.coalesce(F.col("ccc").cast("int"), F.lit(0)).alias("ccc"), "d1").alias("p"))
    )
    # A mark that is not alone on its base, or that no composition takes, needs the general rule below.
    compose = F.str_to_map(F.lit("\x1f".join(f"{a}\x1e{b}" for a, b in pairs)), F.lit("\x1f"), F.lit("\x1e"))
    rows = parts.groupBy("name").agg(F.sort_array(F.collect_list("p")).alias("p"))
    has_marks = F.exists("p", lambda x: x["ccc"] > 0)

    by_place = Window.partitionBy("name").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    clusters = (
        rows.where(has_marks)
        .select("name", F.inline("p"))
        .withColumn("base", F.sum((F.col("ccc") == 0).cast("int")).over(by_place))
        .groupBy("name", "base")
        .agg(F.sort_array(F.collect_list(F.struct("ccc", "pos", "sub", "d1"))).alias("ordered"))
    )

    def composed(step: Column, x: Column) -> Column:
        """Unicode's composition: a mark joins its base unless one of the same or a higher class stands between."""
        joined = F.try_element_at(compose, F.concat(step["base"], x["d1"]))
        take = (x["ccc"] > 0) & (step["last"] < x["ccc"]) & joined.isNotNull()
        return F.struct(
            F.when(x["ccc"] == 0, F.concat(step["done"], step["base"], step["rest"])).otherwise(step["done"]).alias("done"),
            F.when(x["ccc"] == 0, x["d1"]).when(take, joined).otherwise(step["base"]).alias("base"),
            F.when(x["ccc"] == 0, F.lit("")).when(take, step["rest"]).otherwise(F.concat(step["rest"], x["d1"])).alias("rest"),
            F.when((x["ccc"] == 0) | take, F.lit(0)).otherwise(x["ccc"]).alias("last"),
        )

    start = F.expr("named_struct('done', '', 'base', '', 'rest', '', 'last', 0)")
    general = F.when(F.size("ordered") == 1, F.col("ordered")[0]["d1"]).otherwise(F.aggregate("ordered", start, composed, lambda s: F.concat(s["done"], s["base"], s["rest"])))
    simple = rows.where(~has_marks).select("name", F.array_join(F.transform("p", lambda x: x["d1"]), "").alias("raw"))
    whole = clusters.select("name", F.struct("base", general.alias("s")).alias("s"))
    marked = whole.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["s"]), "").alias("raw"))
    rebuilt = odd.join(simple.unionByName(marked), "name", "left")  # a text of unseen characters has no part left
    squeezed = F.trim(F.regexp_replace(F.coalesce("raw", F.lit("")), " {2,}", " "))
    return ascii_only.unionByName(rebuilt.select("text", squeezed.alias("plain")))


def find_lookalikes(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Fields whose stored text differs from its plain form but looks the same.

    cells: record_table, record_id, field_name, text, kind ('label' or 'figure').
    labels: label_text, the correct labels (a reference list; sent to all executors
    only if its counted rows are within the bound).

    A label's plain form is the label_text that looks like it (the smallest, if
    several do; a text that equals one of them is right as it stands).  A figure's
    plain form has no blanks and only ASCII digits, comma, point, hyphen-minus, plus,
    percent sign and brackets.  Null texts, labels that look like none and figures
    without a digit give no row; repeated rows give one.
    """
    wanted = cells.where(F.col("text").isNotNull()).select("record_table", "record_id", "field_name", "text", "kind").distinct()
    known = labels.where(F.col("label_text").isNotNull()).select(F.col("label_text").alias("text")).distinct()
    refs = unify_texts(known, "text").groupBy("plain").agg(F.min("text").alias("label"), F.collect_set("text").alias("same"))
    figure = F.regexp_replace("plain", " ", "")
    label_case = F.when(F.col("label").isNotNull() & ~F.array_contains("same", F.col("text")), F.struct(F.lit("label").alias("kind"), F.col("label").alias("plain_text")))
    figure_case = F.when(figure.rlike(PLAIN_FIGURE) & figure.rlike("[0-9]") & (figure != F.col("text")), F.struct(F.lit("figure").alias("kind"), figure.alias("plain_text")))
    cases = (
        unify_texts(wanted, "text")
        .join(bounded_broadcast(cut(refs)), "plain", "left")
        .select("text", F.inline(F.array_compact(F.array(label_case, figure_case))))
        .select(F.concat("kind", F.lit("\x1f"), "text").alias("key"), "plain_text")
    )
    keyed = wanted.withColumn("key", F.concat("kind", F.lit("\x1f"), "text")).drop("kind", "text")
    found = keyed.join(cases, "key")  # one row a key on the right: the adaptive engine splits what is skewed on the left
    return found.select("record_table", "record_id", "field_name", "plain_text").distinct()


def fields(spark: SparkSession, extracted_cells: DataFrame, cell_proofs: DataFrame) -> DataFrame:
    """The fields of the two tables that hold labels or figures, one row a field."""
    both = extracted_cells.select(F.lit("extracted_cells").alias("record_table"), F.col("cell_id").alias("record_id"), F.explode(F.array(F.struct(F.lit("row_label").alias("field_name"), F.col("row_label").alias("text"), F.lit("label").alias("kind")), F.struct(F.lit("cell_value").alias("field_name"), F.col("cell_value").alias("text"), F.lit("figure").alias("kind")))).alias("f")).select("record_table", "record_id", "f.*")
    return both.unionByName(cell_proofs.select(F.lit("cell_proofs").alias("record_table"), F.col("proof_id").alias("record_id"), F.lit("column_label").alias("field_name"), F.col("column_label").alias("text"), F.lit("label").alias("kind")))
