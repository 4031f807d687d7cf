"""Scalar text functions as built-in expressions: tokens, sizes, keys, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Han characters of the tokeniser, as a class for Java's and RE2's syntax alike.
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
LATIN = r"[a-z0-9]+(?:[._%/-][a-z0-9]+)*"
ENGLISH = r"[a-z0-9]+(?:[.&'-][a-z0-9]+)*"
BLANK = r"[ \t\r\n\f\x{00a0}\x{3000}]+"

# Domain terms that are tokens of their own wherever they stand.
DOMAIN_TERMS = ["营业收入", "营业成本", "净利润", "归属于上市公司股东的净利润", "经营活动产生的现金流量净额", "经营活动现金流量净额", "资产负债表", "现金流量表", "利润表", "审计委员会", "董事会报告"]
# Aliases of metrics, replaced one after the other, and the wording of filings.
SYNONYMS = {"净资产回报率": "净资产收益率", "同比增幅": "比上年同期增减", "一定实现": "计划实现", "前五大客户": "前五名客户", "毛利水平": "毛利率", "主要风险": "可能面对的风险", "销售占比": "销售额占年度销售总额", "营收": "营业收入"}


def search_tokens(text: Column) -> Column:
    """Latin and number tokens, then Han bigrams of each run (a lone character stays), then the domain terms present."""
    low = F.lower(text)
    latin = F.regexp_extract_all(F.regexp_replace(low, HAN + "+", " "), F.lit(LATIN), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(HAN + "+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, 2)))))
    terms = F.filter(F.array(*[F.lit(t) for t in DOMAIN_TERMS]), lambda t: F.contains(low, t))
    return F.concat(latin, pairs, terms)


def english_tokens(text: Column) -> Column:
    """Lower-case words and numbers with inner joiners."""
    return F.regexp_extract_all(F.lower(text), F.lit(ENGLISH), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Han characters plus 1.3 times the Latin tokens, rounded up, at least 1."""
    han = F.size(F.regexp_extract_all(text, F.lit(HAN), F.lit(0)))
    latin = F.size(F.regexp_extract_all(F.lower(F.regexp_replace(text, HAN, " ")), F.lit(LATIN), F.lit(0)))
    return F.greatest(F.lit(1), han + F.ceil(latin * 1.3)).cast("int")


def repeated_key(text: Column) -> Column:
    """Key under which headers and footers repeat: no blanks, digits as #, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, BLANK, ""), "[0-9]+", "#"))


def is_page_number(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "").rlike(r"^(?:第)?[0-9]+(?:页)?(?:/[0-9]+)?$")


def expand_query(query: Column) -> Column:
    """Aliases in a query replaced by the wording of filings, in order."""
    for alias, wording in SYNONYMS.items():
        query = F.replace(query, F.lit(alias), F.lit(wording))
    return query


def plain_value(value: Column) -> Column:
    """A number for comparison: no commas and plus signs, one kind of minus."""
    return F.translate(value, "−,+", "-")


def plain_label(label: Column) -> Column:
    return F.regexp_replace(label, BLANK, "")


def heading_level(text: Column) -> Column:
    """Level 1 to 4 of a numbered heading, null for other lines.

    Rows of tables (two numbers or more), dotted contents lines and lines over 100
    characters are none; from level 2 on, neither are sentences and lines over 60.
    """
    t = F.trim(F.regexp_replace(text, BLANK, " "))
    numbers = F.size(F.regexp_extract_all(t, F.lit(r"[-+]?[0-9][0-9,.]*"), F.lit(0)))
    never = (t == "") | (F.char_length(t) > 100) | (numbers >= 2) | t.rlike(r"\.{5,}|…{3,}")
    free = (F.char_length(t) <= 60) & ~t.rlike("[。；;，,：:]$")
    numerals = "一二三四五六七八九十百千万零〇"
    levels = [
        (1, rf"^第[{numerals}0-9]+[编章节] *[^ ]+"), (2, rf"^[{numerals}]+、 *[^ ]+"), (3, rf"^[（(][{numerals}0-9]+[）)] *[^ ]+"), (4, r"^[0-9]+(?:\.[0-9]+)+[.、]? *[^ ]+"), (4, r"^[0-9]+[.、] *[^ ]+"),
    ]
    out = F.when(never, None)
    for level, pattern in levels:
        out = out.when(t.rlike(pattern) & (F.lit(level == 1) | free), level)
    return out


def number_tokens(text: Column) -> Column:
    """Numbers of a text without commas; years from 1900 to 2100 are left out, repeated numbers stay."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.filter(found, lambda x: ~x.rlike("^(?:19[0-9][0-9]|20[0-9][0-9]|2100)$"))


def ordered_contains(text: Column, parts: Column) -> Column:
    """Whether the parts occur in a text one after the other."""
    found = lambda at, p: F.position(p, text, at)
    step = F.aggregate(parts, F.lit(1), lambda at, p: F.when((at == 0) | (found(at, p) == 0), 0).otherwise(found(at, p) + F.length(p)))
    return step > 0
