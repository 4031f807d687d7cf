"""Texts cut off by a field limit of their source or in transfer.

For each source a right-censored log-normal is fitted to its lengths, in characters and
in bytes, by maximum likelihood (EM over the histogram); the lengths where the hazard
jumps are the candidate limits.  A text at a limit has the posterior that it was censored
there as its prior of a cut, any other the rate at which its source is cut in transfer.
The ending multiplies it by a likelihood ratio that is estimated for each source: how
often texts of the source end so where they are broken off at a random place, against how
often its whole texts end so.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.runtime import bounded_broadcast, cut

#: A length is a candidate limit if so large a share of the texts that reach it end there,
LEAST_HAZARD = 0.15
#: and if at least so many texts, and so many times the neighbouring lengths' average, do.
LEAST_TEXTS, LEAST_JUMP = 4, 6.0

#: The share of a source's texts that transfer may cut at no limit; what ends openly beyond it is the source's style.
MOST_TRANSFER = 0.25
#: Texts' worth of weight that the average over all sources has in the estimates of one source.
SHRINK = 100.0
#: Kinds of ending whose meaning is estimated.  A text that ends in a mark or remnant of a cut is cut, and one
#: that ends with a full sentence is not, whatever its length: that is what being cut means here.
OPEN_KINDS = ["open", "number", "closed"]

BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# What stands after a cut, and the lines that close a text without a full stop.
TORN = r"(?:…|\.{3}|⋯|\[(?:more|\.\.\.|…)\]?|\((?:more|cont)[^)]*\)?|<[a-z/!]*|&[#a-z0-9]*|[（(]未完[^）)]*[）)]?|下转.*|未完待续|\x{FFFD}+|\\u?[0-9a-f]*)$"
WHOLE = r"[。！？!?．.][”’」』）)\"'\]】]*$"
CLOSED = (
    r"(?:^|\n)(?:[^\n]*\t\s*[-+(（]?[0-9][0-9,.]*[)）%％]?|[^\n，。；,;]{0,12}[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[^\n，。；,;0-9]{0,40}(?:董事会|有限公司|委员会)|"
    r"[（(]完[）)]|(?:来源|联系|附件|附表|电话|传真|地址|邮箱|网址|撰文|编辑|注)[^\n。]{0,40}|(?:Source|Contact|Enclosure|Attachment|Tel|Phone|Email|Web|Signed|Dated?|Editor)\b[^\n]{0,60}|https?://\S+|\S+@\S+\.\S+|"
    r"For and on behalf of[^\n]*(?:\n[A-Z][^\n.]{0,60})?|(?:January|February|March|April|May|June|July|August|September|October|November|December|[0-9]{1,2})\s+[A-Z0-9][a-z0-9]*,?\s+[0-9]{4})\s*$"
)
TITLE = r"^(?:[^\n。，；！？]{1,80}(?:公告|报告|通知|说明|决议|摘要|议案|办法|制度|细则|意见|公示|通告|声明|函|书)(?:[（(][^\n]{0,20}[)）])?|(?i:notice|announcement|report|annual|interim|quarterly|notes|minutes|statement|summary|circular|proposal|resolution|letter|press release)\b[^\n.,;!?]{0,120})$"


def with_ending(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the kind of ending of a text: torn, open, number, closed or whole; null for null, empty and blank texts.

    Step by step, so that the trimmed text and its last two lines (whole) are cut out once.
    """
    t, tail = F.col("__t"), F.col("__tail")
    cut_out = rows.withColumn("__t", F.rtrim(F.col(text), F.lit(BLANKS))).withColumn("__tail", F.substring_index(t, "\n", -2))
    # a point after a figure that goes on: after a currency, a preposition or Chinese words, without decimals
    number = tail.rlike(r"(?:[\x{4e00}-\x{9fff}]|\b(?:RMB|CNY|USD|EUR|by|to|of|at|with|against|than|reached|filed|from|or)\s|[$¥])[0-9]{1,3}(?:,[0-9]{3})*\.$")
    kind = (
        F.when(t.isNull() | (t == ""), None).when(tail.rlike(TORN), "torn").when(number, "number").when(tail.rlike(WHOLE), "whole").when(tail.rlike(CLOSED), "closed").when(t.rlike(TITLE), "closed").otherwise("open")
    )
    return cut_out.withColumn(name, kind).drop("__t", "__tail")


def _fit(lengths: np.ndarray, counts: np.ndarray, slack: int) -> list[tuple[int, int, float, int]]:
    """(low, high, posterior, texts) for each limit of one source and measure."""
    order = np.argsort(lengths)
    x, n = lengths[order].astype(float), counts[order].astype(float)
    keep = x > 0
    x, n = x[keep], n[keep]
    if not len(x):
        return []
    # a limit in bytes cuts up to three bytes early, so that no character is split
    cum = np.append(0, np.cumsum(n))
    at = lambda a, b: cum[np.searchsorted(x, b, side="right")] - cum[np.searchsorted(x, a)]
    total = cum[-1]
    width = slack + 1
    spikes: list[tuple[float, float, float]] = []
    for high in x[::-1]:
        low = high - slack
        if spikes and high >= spikes[-1][0]:
            continue
        inside = at(low, high)
        beside = (at(low - 10 * width, low - 1) + at(high + 1, high + 10 * width)) / 20
        reach = total - cum[np.searchsorted(x, low)]
        if inside >= LEAST_TEXTS and inside >= LEAST_JUMP * max(beside, 0.2) and inside >= LEAST_HAZARD * reach:
            # of overlapping windows the fullest
            best = max((h for h in x[(x <= high) & (x > high - width)]), key=lambda h: (at(h - slack, h), h))
            spikes.append((best - slack, best, at(best - slack, best)))
    if not spikes:
        return []
    y = np.log(x)
    limit = np.zeros(len(x), dtype=bool)
    for low, high, _ in spikes:
        limit |= (x >= low) & (x <= high)
    free = ~limit
    mu = float(np.average(y, weights=n))
    sigma = max(float(np.sqrt(np.average((y - mu) ** 2, weights=n))), 0.1)
    phi = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    tail = lambda z: max(math.erfc(z / math.sqrt(2)) / 2, 1e-12)
    share = [0.5] * len(spikes)
    post = [0.5] * len(spikes)
    for _ in range(60):
        w, s1, s2 = n[free].sum(), (n[free] * y[free]).sum(), (n[free] * y[free] ** 2).sum()
        for i, (_low, high, count) in enumerate(spikes):
            z = (math.log(high) - mu) / sigma
            beyond = tail(z)
            own = phi(z) / (sigma * high) * width
            post[i] = share[i] * beyond / (share[i] * beyond + (1 - share[i]) * own + 1e-15)
            cut = count * post[i]
            reach = total - cum[np.searchsorted(x, high, side="right")]
            share[i] = min(0.999, max(0.001, cut / (cut + reach + count * (1 - post[i]) + 1e-9)))
            hazard = phi(z) / beyond
            mean = mu + sigma * hazard
            square = mean * mean + sigma * sigma * (1 + z * hazard - hazard * hazard)
            stay = count - cut
            w, s1, s2 = w + count, s1 + cut * mean + stay * math.log(high), s2 + cut * square + stay * math.log(high) ** 2
        mu, sigma = s1 / w, max(math.sqrt(max(s2 / w - (s1 / w) ** 2, 1e-4)), 0.05)
    return [(int(low), int(high), float(p), int(count)) for (low, high, count), p in zip(spikes, post, strict=True)]


def source_limits(measured: DataFrame) -> DataFrame:
    """(source, measure, low, high, posterior, texts): the limits of each source.

    measured: source, n_char, n_byte.  The lengths are counted before they are shuffled,
    so a source that holds a third of all texts is a histogram like any other.
    """
    both = measured.select("source", F.explode(F.array(F.struct(F.lit("char").alias("measure"), F.col("n_char").alias("n")), F.struct(F.lit("byte").alias("measure"), F.col("n_byte").alias("n")))).alias("m"))
    histogram = both.groupBy("source", "m.measure", "m.n").agg(F.count("*").alias("texts"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        measure = group["measure"].iloc[0]
        rows = _fit(group["n"].to_numpy(), group["texts"].to_numpy(), 3 if measure == "byte" else 0)
        return pd.DataFrame([(group["source"].iloc[0], measure, *r) for r in rows], columns=["source", "measure", "low", "high", "posterior", "texts"])

    return histogram.groupBy("source", "measure").applyInPandas(fit, "source string, measure string, low int, high int, posterior double, texts long")


def _profiles(rows: DataFrame) -> DataFrame:
    """(s, transfer, ratio_open, ratio_number, ratio_closed): what the endings of each source say.

    rows: s, posterior, ending, broken (the ending of the text broken off at a random place).
    Texts at no limit are a mixture of those cut in transfer, which end like broken ones, and
    whole ones; the transfer rate is the largest that their open endings allow, at most
    MOST_TRANSFER.  One row a source, counted before it is shuffled.
    """
    free = F.col("posterior") == 0
    counts = [F.count_if(free).alias("n"), F.count("broken").alias("m")]
    for k in OPEN_KINDS:
        counts += [F.count_if(free & (F.col("ending") == k)).alias(f"n_{k}"), F.count_if(F.col("broken") == k).alias(f"m_{k}")]
    by_source = rows.where("ending is not null").groupBy("s").agg(*counts)
    sums = by_source.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in by_source.columns[1:]]).first()

    def shrunk(count: str, of: str) -> Column:
        return (F.col(count) + SHRINK * sums[count] / max(sums[of], 1)) / (F.col(of) + SHRINK)

    broken = {k: shrunk(f"m_{k}", "m") for k in OPEN_KINDS}
    seen = {k: shrunk(f"n_{k}", "n") for k in OPEN_KINDS}
    transfer = F.least(F.lit(MOST_TRANSFER), seen["open"] / F.greatest(broken["open"], F.lit(1e-6)))
    out = by_source.withColumn("transfer", transfer)
    least = 0.5 / (F.col("n") + SHRINK)
    for k in OPEN_KINDS:
        whole = F.greatest(seen[k] - F.col("transfer") * broken[k], least) / (1 - F.col("transfer"))
        out = out.withColumn(f"ratio_{k}", broken[k] / whole)
    return out.select("s", "transfer", *[f"ratio_{k}" for k in OPEN_KINDS])


def judge(documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, ending, posterior, odds, cut) for every row of documents.

    posterior: of censoring at a limit, 0 at none.  cut: whether the log odds of a cut,
    prior and likelihood ratio of the ending together, are above 0.  Null, empty and blank
    texts are never cut and take no part in the fit; a null source is a source of its own.
    The texts are read once, whole; what goes on is their lengths and kinds of ending.
    """
    t, n = F.col("t"), F.char_length("t")
    at = F.when(n > 1, F.pmod(F.xxhash64(t), n - 1).cast("int") + 1)
    read = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(source), F.lit("")).alias("s"), F.col(text).alias("t"))
    read = with_ending(read.withColumn("start", F.substr(t, F.lit(1), at)), "start", "broken")
    rows = cut(with_ending(read, "t", "ending").select("doc_id", "source", "s", n.alias("n_char"), F.octet_length(t).alias("n_byte"), "ending", "broken"))
    limits = cut(source_limits(rows.where("ending is not null").select(F.col("s").alias("source"), "n_char", "n_byte")))
    spread = limits.groupBy("source").agg(F.collect_list(F.struct("measure", "low", "high", "posterior")).alias("limits"))
    joined = rows.join(bounded_broadcast(spread.withColumnRenamed("source", "s")), "s", "left")
    length = lambda x: F.when(x["measure"] == "char", F.col("n_char")).otherwise(F.col("n_byte"))
    hit = F.filter("limits", lambda x: (length(x) >= x["low"]) & (length(x) <= x["high"]))
    placed = joined.withColumn("posterior", F.coalesce(F.array_max(F.transform(hit, lambda x: x["posterior"])), F.lit(0.0)))
    known = placed.join(bounded_broadcast(cut(_profiles(placed))), "s", "left")
    prior = F.least(F.when(F.col("posterior") > 0, F.col("posterior")).otherwise(F.col("transfer")), F.lit(0.9999))
    ratio = F.coalesce(*[F.when(F.col("ending") == k, F.col(f"ratio_{k}")) for k in OPEN_KINDS])
    odds = F.when(F.col("ending") == "torn", F.lit(math.inf)).when(F.col("ending") == "whole", F.lit(-math.inf)).otherwise(F.log(prior / (1 - prior) * ratio))
    return known.withColumn("odds", odds).select("doc_id", "source", "ending", "posterior", "odds", F.coalesce(F.col("odds") > 0, F.lit(False)).alias("cut"))


def cut_documents(judged: DataFrame) -> DataFrame:
    return judged.where("cut and doc_id is not null").select("doc_id").distinct()


def cut_shares(judged: DataFrame) -> DataFrame:
    """(source, documents, cut, share) over the documents with a text."""
    return judged.where(F.col("ending").isNotNull()).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("int")).alias("share"))
