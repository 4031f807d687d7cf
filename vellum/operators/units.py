"""Figures in different units and scales, brought to the base unit of their kind.

A figure's unit is read, in this order, from its own text, the unit field, the column
label, the row label and the section; spellings are looked up in a lexicon generated
from multipliers and unit names.  Figures whose unit is missing, or stands there as a
bare multiplier ('1.2亿'), go to a calibrated tree ensemble that predicts the unit (of a
multiplier: the kind) from magnitude, notation, source, category and the neighbouring
fields of the row; confident assignments are converted and the others, like spellings
that the lexicon doesn't know, are marked for review.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.forest import Forest, fit_forest

# Multipliers, in Chinese and English, and the names of units.
ZH_SCALES = {"": 1, "十": 10, "百": 100, "千": 10**3, "万": 10**4, "十万": 10**5, "百万": 10**6, "千万": 10**7, "亿": 10**8, "十亿": 10**9, "百亿": 10**10, "千亿": 10**11, "万亿": 10**12}
EN_SCALES = {
    "": 1, "10": 10, "100": 100, "k": 10**3, "thousand": 10**3, "'000": 10**3, "000": 10**3, "1000": 10**3, "10k": 10**4, "10000": 10**4, "10thousand": 10**4, "100k": 10**5, "100thousand": 10**5,
    "m": 10**6, "mn": 10**6, "mm": 10**6, "mln": 10**6, "million": 10**6, "10m": 10**7, "10million": 10**7, "100m": 10**8, "100mn": 10**8, "100million": 10**8, "bn": 10**9, "billion": 10**9, "tn": 10**12, "trillion": 10**12,
}
CURRENCY_NAMES = ["rmb", "cny", "yuan", "rmbyuan", "renminbi"]
ZH_UNITS = {
    "t": {"吨": "1", "千克": "0.001", "公斤": "0.001"}, "kWh": {"千瓦时": "1", "度": "1", "兆瓦时": "1000", "吉瓦时": "1000000"},
    "m2": {"平方米": "1", "公顷": "10000", "平方公里": "1000000", "平方千米": "1000000"}, "share": {"股": "1"}, "person": {"人": "1", "名": "1"},
}
EN_UNITS = {
    "t": {"t": "1", "tonne": "1", "tonnes": "1", "ton": "1", "tons": "1", "metrictons": "1", "kt": "1000", "mt": "1000000", "kg": "0.001", "kilograms": "0.001"},
    "kWh": {"kwh": "1", "mwh": "1000", "gwh": "1000000", "twh": "1000000000"},
    "m2": {"m2": "1", "sqm": "1", "squaremetres": "1", "squaremeters": "1", "ha": "10000", "hectare": "10000", "hectares": "10000", "km2": "1000000", "sqkm": "1000000"},
    "share": {"share": "1", "shares": "1"}, "person": {"person": "1", "persons": "1", "people": "1", "employees": "1"},
}
RATES = {
    "%": "1", "percent": "1", "percentage": "1", "pct": "1", "百分点": "1", "百分比": "1", "pp": "1", "ppt": "1", "percentagepoint": "1", "percentagepoints": "1",
    "‰": "0.1", "permille": "0.1", "permil": "0.1", "千分比": "0.1", "千分点": "0.1", "bp": "0.01", "bps": "0.01", "basispoint": "0.01", "basispoints": "0.01", "基点": "0.01", "万分点": "0.01", "‱": "0.01",
    "小数": "100", "比例小数": "100", "fraction": "100", "decimal": "100", "decimalfraction": "100",
}
FOREIGN = ["美元", "港元", "港币", "欧元", "英镑", "日元", "usd", "hkd", "eur", "gbp", "jpy", "us$", "hk$", "$", "€", "£"]
OTHER_COUNTS = ["次", "天", "日", "年", "月", "小时", "倍", "台", "套", "件", "家", "项", "个", "户", "辆", "times", "days", "hours", "units", "sets", "x", "元每股", "元股", "元/股", "元/每股", "yuan/share", "rmb/share", "cny/share", "yuanshare", "yuanpershare", "rmbshare", "rmbpershare"]
BASE_UNITS = ["CNY", "t", "kWh", "m2", "share", "person", "percent"]

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
_SAME = {"−": "-", "–": "-", "‐": "-", "‑": "-", "﹣": "-", "￥": "¥", "²": "2", "【": "[", "】": "]", "〔": "[", "〕": "]", "、": ","}
_SAME |= dict.fromkeys("\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " ")
_GONE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f\ufe0e\ufe0f"

#: Rows that the ensemble is fitted on at most; the only part that doesn't read every row.
SAMPLE_ROWS = 8_000
#: Calibrated confidence from which a predicted unit is taken.
CONFIDENT = 0.9


def narrow(c: Column) -> Column:
    """Full-width forms, blanks and minus signs as ASCII, unseen characters dropped (built-ins only)."""
    return F.translate(c, _WIDE + "".join(_SAME) + _GONE, _ASCII + "".join(_SAME.values()))


def unit_key(c: Column) -> Column:
    """The spelling under which the lexicon holds a unit."""
    bare = F.regexp_replace(F.lower(narrow(c)), "㎡", "m2")
    bare = F.regexp_replace(bare, r"\((?:合并口径|母公司口径|合并|consolidated)\)|币种.*$|currency.*$", "")
    bare = F.regexp_replace(bare, r"^\s*[(\[]*\s*(?:(?:金额|数量|计量)?单位\s*:|units?\s*:|in\s+)", "")
    return F.regexp_replace(bare, r"[\s()\[\],.:;]|^个", "")


@lru_cache(1)
def lexicon() -> pd.DataFrame:
    """key, kind, factor100 (base units times 100), scale (power of ten of the multiplier): every spelling that multipliers and unit names make.

    kind is null for other currencies, per-share amounts and counts of other things, and
    '?' for a bare multiplier, whose kind the ensemble has to tell.
    """
    rows: dict[str, tuple[str | None, Decimal | None, int | None]] = {}

    def put(key: str, kind: str | None, factor: Decimal | None, n: int | None = None) -> None:
        key = re.sub(r"[\s(),.]", "", key.lower())
        if key and (factor is None or factor <= 10**15):
            rows.setdefault(key, (kind, factor, None if n is None else len(str(n)) - 1))

    for unit, f in RATES.items():
        put(unit, "percent", Decimal(f))
    for word, n in ZH_SCALES.items():
        for form in (f"{word}元", f"{word}元人民币", f"人民币{word}元", f"{word}人民币", f"{word}元rmb", f"{word}圆"):
            put(form, "CNY", Decimal(n), n)
        for kind, units in ZH_UNITS.items():
            for unit, f in units.items():
                put(word + unit, kind, Decimal(f) * n, n)
        for name in FOREIGN + OTHER_COUNTS:
            put(word + name, None, None)
    for word, n in EN_SCALES.items():
        for name in CURRENCY_NAMES:
            put(name + word, "CNY", Decimal(n), n)
            put(word + name, "CNY", Decimal(n), n)
        for kind, units in EN_UNITS.items():
            for unit, f in units.items():
                put(word + unit, kind, Decimal(f) * n, n)
        for name in FOREIGN + OTHER_COUNTS:
            put(name + word, None, None)
            put(word + name, None, None)
    for scales in (ZH_SCALES, EN_SCALES):
        for word, n in scales.items():
            if word and not word[0].isdigit() and word != "'000":
                put(word, "?", Decimal(n), n)
    table = [(k, kind, None if f is None else str(f * 100), None if n is None else str(n)) for k, (kind, f, n) in rows.items()]
    return pd.DataFrame(table, columns=["key", "kind", "factor100", "scale"])


def _number(text: Column) -> tuple[Column, Column]:
    """The figure as a decimal, with sign, and what stands after it."""
    pattern = r"^\s*[¥$€]?\s*([(+\-]?)\s*[¥]?\s*([0-9](?:[0-9, ]*[0-9])?(?:\.[0-9]+)?|\.[0-9]+)(e[+\-]?[0-9]+)?\s*(\)?)\s*([^0-9]*(?:m2|km2)?[^0-9]*)$"
    t = F.lower(F.regexp_replace(narrow(text), "㎡", "m2"))
    part = lambda i: F.regexp_extract(t, pattern, i)
    plain = F.concat(F.regexp_replace(part(2), "[ ,]", ""), part(3)).try_cast("decimal(26,8)")
    negative = (part(1) == "-") | (part(1) == "(")
    return F.when(negative, -plain).otherwise(plain), part(5)


def _label_unit(label: Column) -> Column:
    """What stands behind a label in brackets, after a comma or after a slash."""
    return F.regexp_extract(narrow(label), r"^[^(\[,/]*[(\[,/]\s*(.*?)[)\]]?\s*$", 1)


def _section_unit(section: Column) -> Column:
    return F.regexp_extract(F.lower(narrow(section)), r"(?:单位|units?)\s*:\s*(.*?)\s*(?:币种.*)?$", 1)


#: Columns of a table of figures; a missing one counts as null.
FIGURE_COLUMNS = ["record_table", "record_key", "figure", "unit", "column_label", "row_label", "section", "category", "source"]


def figures(cell_proofs: DataFrame, agent_cases: DataFrame) -> DataFrame:
    """The figures of the two tables in one form."""
    origin = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    cells = cell_proofs.select(
        F.lit("cell_proofs").alias("record_table"), F.col("proof_id").cast("string").alias("record_key"), F.col("cell_value").alias("figure"),
        "unit", "column_label", "row_label", "section", F.col("table_type").alias("category"), origin(F.col("document_key")).alias("source"),
    )
    facts = agent_cases.select("case_id", "query", "task_type", "source", F.explode("expected_facts").alias("f"))
    # 'first unit / second unit': the first belongs to the first acceptable value, unless the slash is a rate's
    unit = F.col("f.unit")
    per = F.regexp_replace(narrow(unit), r"\s", "").rlike("/(?:股|share)|per")
    none = F.lit(None).cast("string")
    cases = facts.select(
        F.lit("agent_cases").alias("record_table"), F.concat("case_id", F.lit("#"), "f.fact_id").alias("record_key"), F.get("f.acceptable_values", F.lit(0)).alias("figure"),
        F.when(per, unit).otherwise(F.split_part(narrow(unit), F.lit("/"), F.lit(1))).alias("unit"), none.alias("column_label"), none.alias("row_label"), none.alias("section"), F.col("task_type").alias("category"), "source",
    )
    return cells.unionByName(cases)


def _own(rows: DataFrame) -> DataFrame:
    """The columns of figures alone, whatever else a table brings along."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in FIGURE_COLUMNS])


def stated_units(rows: DataFrame) -> DataFrame:
    """Adds number, kind, factor100, scale, unit_from: the unit that the row itself states.

    unit_from is value, unit, column, row or section, or null where no field states one.
    kind is one of BASE_UNITS, '' for what has no base unit, '?' for a bare multiplier and
    '!' for an unknown spelling.
    """
    spark = rows.sparkSession
    lex = F.broadcast(spark.createDataFrame(lexicon(), "key string, kind string, factor100 string, scale string").withColumn("scale", F.col("scale").cast("int")).withColumn("factor100", F.col("factor100").cast("decimal(26,4)")))  # generated, a few thousand rows whatever the data
    number, rest = _number(F.col("figure"))
    parsed = rows.withColumn("__n", number).withColumn("__rest", rest)
    keys = {"value": F.col("__rest"), "unit": F.col("unit"), "column": _label_unit(F.col("column_label")), "row": _label_unit(F.col("row_label")), "section": _section_unit(F.col("section"))}
    out = parsed.withColumns({f"__k_{n}": F.when(F.col("__n").isNotNull(), unit_key(k)) for n, k in keys.items()})
    for n in keys:
        out = out.join(lex.select(F.col("key").alias(f"__k_{n}"), F.struct(F.coalesce("kind", F.lit("")).alias("kind"), "factor100", "scale").alias(f"__u_{n}")), f"__k_{n}", "left")
    # a non-empty text or unit field that the lexicon doesn't know is a spelling to be looked at
    said = {
        n: F.when(F.col(f"__u_{n}").isNotNull(), F.struct(F.lit(n).alias("unit_from"), F.col(f"__u_{n}.kind").alias("kind"), F.col(f"__u_{n}.factor100").alias("factor100"), F.col(f"__u_{n}.scale").alias("scale")))
        for n in keys
    }
    for n in ("value", "unit"):
        unknown = F.col(f"__k_{n}") != ""
        said[n] = said[n].when(unknown, F.struct(F.lit(n).alias("unit_from"), F.lit("!").alias("kind"), F.lit(None).cast("decimal(26,4)").alias("factor100"), F.lit(None).cast("int").alias("scale")))
    out = out.withColumn("__s", F.coalesce(*said.values()))
    return out.select(*rows.columns, F.col("__n").alias("number"), F.col("__s.unit_from").alias("unit_from"), F.col("__s.kind").alias("kind"), F.col("__s.factor100").alias("factor100"), F.col("__s.scale").alias("scale"))


_BUCKETS = {"row_label": 96, "column_label": 16, "category": 8, "source": 12}


def _features(f: pd.DataFrame) -> np.ndarray:
    """Magnitude and notation of the figure; its label, column, category and source as hashed indicators."""
    number = pd.to_numeric(f["number"], errors="coerce").fillna(0.0).to_numpy(float)
    figure = f["figure"].fillna("")
    size = np.log10(np.abs(number) + 1e-6)
    decimals = figure.str.extract(r"[.\uff0e]([0-9\uff10-\uff19]+)", expand=False).fillna("").str.len().to_numpy(float)
    columns = [size, decimals, figure.str.contains("[,\uff0c]").to_numpy(float), (number < 0).astype(float), figure.str.len().to_numpy(float)]
    for name, buckets in _BUCKETS.items():
        known = f[name].fillna("").astype(str)
        if name.endswith("label"):
            known = known.str.replace(r"[\uff08(\[,\uff0c/\uff0f].*$", "", regex=True).str.replace(r"[0-9]+", "", regex=True)
        codes, values = pd.factorize(known)
        hashed = np.array([zlib.crc32(f"{name}={v}".encode()) % buckets for v in values], dtype=np.int64) if len(values) else np.zeros(0, np.int64)
        hot = np.zeros((len(f), buckets))
        if len(f):
            hot[np.arange(len(f)), hashed[codes]] = 1
        columns.append(hot)
    return np.column_stack(columns) if len(f) else np.zeros((0, 5 + sum(_BUCKETS.values())))


@dataclass
class UnitModel:
    """unit: kind and factor of a figure that states neither.  kind: what a bare multiplier counts; it sees the multiplier too."""

    unit: Forest
    kind: Forest


def _with_scale(f: pd.DataFrame) -> np.ndarray:
    return np.column_stack([_features(f), pd.to_numeric(f["scale"], errors="coerce").fillna(-1.0).to_numpy(float)])


def fit_unit_model(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UnitModel:
    """The ensembles, fitted on the stated units of a bounded sample (the rows of smallest hash), the second on those with a multiplier."""
    sample = _own(rows).orderBy(F.xxhash64("record_table", "record_key"), "record_key").limit(sample_rows)
    known = stated_units(sample).where(F.col("kind").isin(*BASE_UNITS)).select("figure", "number", *_BUCKETS, "kind", "scale", F.concat_ws("|", "kind", F.col("factor100").cast("string")).alias("y")).toPandas()
    counted = known[(known["kind"] != "percent") & (pd.to_numeric(known["scale"], errors="coerce").fillna(0) > 0)]
    return UnitModel(fit_forest(_features(known), known["y"].to_numpy(str)), fit_forest(_with_scale(counted), counted["kind"].to_numpy(str)))


def convert_units(rows: DataFrame, *, sample_rows: int = SAMPLE_ROWS, confident: float = CONFIDENT, model: UnitModel | None = None) -> DataFrame:
    """Every figure with its unit and its value in the base unit of its kind.

    rows: the columns FIGURE_COLUMNS.  Result: record_table, record_key, figure, number,
    unit_from, status, base_unit, factor, base_value, confidence.

    status: 'stated' (a field names the unit), 'scale' (the text has a bare multiplier,
    the ensemble tells the kind with at least `confident` calibrated confidence),
    'predicted' (no unit, the ensemble tells it as surely), 'review' (either with less
    confidence, or a spelling that is in no lexicon), 'other' (another currency, a
    per-share amount or a count of other things), 'none' (null, empty or without a number).  base_value is the figure in base units times 100, rounded to a whole; null
    for review, other and none, and where it exceeds a bigint.  Rows are kept as often as
    they come; an empty table gives an empty table.
    """
    model = fit_unit_model(rows, sample_rows) if model is None else model
    forest, kind_forest = model.unit, model.kind
    stated = stated_units(_own(rows))
    open_ = F.col("number").isNotNull() & (F.col("kind").isNull() | (F.col("kind") == "?"))
    kinds = np.array([str(c).split("|")[0] for c in forest.classes])
    factors = [str(c).split("|")[-1] for c in forest.classes]

    @F.pandas_udf("struct<kind:string, factor100:string, confidence:double, counted:string, counted_confidence:double>")
    def predict(f: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"kind": None, "factor100": None, "confidence": np.nan, "counted": None, "counted_confidence": np.nan}, index=f.index, dtype=object)
        need = f["open"].fillna(False).to_numpy(bool)
        if need.any():
            p = forest.probabilities(_features(f[need]))
            best = p.argmax(axis=1)
            out.loc[need, "kind"] = kinds[best]
            out.loc[need, "factor100"] = np.array(factors, dtype=object)[best]
            out.loc[need, "confidence"] = forest.confidence(p.max(axis=1))
            bare = need & f["bare"].fillna(False).to_numpy(bool)
            if bare.any():
                p = kind_forest.probabilities(_with_scale(f[bare]))
                out.loc[bare, "counted"] = kind_forest.classes[p.argmax(axis=1)]
                out.loc[bare, "counted_confidence"] = kind_forest.confidence(p.max(axis=1))
        out["counted_confidence"] = out["counted_confidence"].astype(float)
        out["confidence"] = out["confidence"].astype(float)
        return out

    fields = F.struct(open_.alias("open"), F.coalesce(open_ & (F.col("kind") == "?"), F.lit(False)).alias("bare"), F.when(open_, F.col("scale")).alias("scale"), *[F.when(open_, F.col(c)).alias(c) for c in ("figure", *_BUCKETS)], F.when(open_, F.col("number").cast("double")).alias("number"))
    scored = stated.withColumn("p", predict(fields))
    bare = F.col("kind") == "?"
    trust = F.when(bare, F.col("p.counted_confidence")).otherwise(F.col("p.confidence"))
    sure = F.coalesce(trust >= confident, F.lit(False))
    status = (
        F.when(F.col("number").isNull(), "none").when(F.col("kind") == "!", "review").when(bare & sure, "scale").when(bare, "review")
        .when(F.col("kind") == "", "other").when(F.col("kind").isNotNull(), "stated").when(sure, "predicted").otherwise("review")
    )
    out = scored.withColumn("status", status)
    is_ = lambda *s: F.col("status").isin(*s)
    base = F.when(is_("stated"), F.col("kind")).when(is_("scale"), F.col("p.counted")).when(is_("predicted"), F.col("p.kind"))
    factor100 = F.when(is_("stated", "scale"), F.col("factor100")).when(is_("predicted"), F.col("p.factor100").try_cast("decimal(26,4)"))
    value = F.round(F.try_multiply(F.col("number"), factor100), 0).try_cast("bigint")
    return out.select(
        "record_table", "record_key", "figure", "number", "unit_from", "status", base.alias("base_unit"), (factor100 / 100).cast("decimal(28,6)").alias("factor"), value.alias("base_value"),
        F.when(is_("stated"), F.lit(1.0)).when(~is_("none", "other"), trust).alias("confidence"),
    )


def converted_figures(units: DataFrame) -> DataFrame:
    """The figures whose own unit differs from the base unit by a factor other than 1, as distinct rows."""
    own = F.col("status").isin("stated", "scale") & (F.col("factor") != 1) & F.col("base_value").isNotNull()
    return units.where(own & F.col("record_key").isNotNull()).select("record_table", "record_key", "base_unit", "base_value").distinct()


def p1_units(spark: SparkSession, cell_proofs: DataFrame, agent_cases: DataFrame) -> DataFrame:
    return convert_units(figures(cell_proofs, agent_cases))
