import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.llm import scans

WORDS = "committee reviewed estimate further adjustments remain possible management believes liquidity position department modern burden morning internal control audit income during period recorded government grants should persist number market common furnished".split()
TERMS = "营业收入 营业成本 净利润 期末余额 合同负债 产能利用率 销售费用 财务费用 项目 目标 本期 未来 年末 成本".split()


def page(rng):
    lines = []
    for _ in range(5):
        lines.append("，".join(f"{rng.choice(TERMS)}为{rng.randint(1, 999)}元" for _ in range(4)) + "。")
        lines.append(" ".join(rng.choice(WORDS) for _ in range(9)) + f" {rng.randint(100, 99999):,} year-on-year.")
    return "\n".join(lines)


def noisy(rng, text, kind):
    """(text with one noise put in, line, what is wrong) or None."""
    if kind == "han":
        back = {v: k for k, v in scans.MISREAD_HAN.items()}
        i = rng.choice([i for i, c in enumerate(text) if c in back])
        return text[:i] + back[text[i]] + text[i + 1 :], text[:i].count("\n")
    if kind == "word":
        wrong, right = rng.choice([p for p in scans.MISREAD_LATIN if p[0] not in ("1", "0", "5") or True])
        places = [i for i in range(len(text) - 1) if text.startswith(right, i) and text[max(0, i - 1)].isalpha() and text[min(i + len(right), len(text) - 1)].isalpha() and text[i].isascii()]
        if not places:
            return None
        i = rng.choice(places)
        return text[:i] + wrong + text[i + len(right) :], text[:i].count("\n")
    if kind == "figure":
        places = [i for i in range(1, len(text)) if text[i] in "0125689" and text[i - 1].isdigit() and text[i + 1].isdigit()]
        i = rng.choice(places)
        return text[:i] + rng.choice([w for w, r in scans.MISREAD_DIGITS.items() if r == text[i]]) + text[i + 1 :], text[:i].count("\n")
    lines = text.split("\n")
    n = rng.choice([k for k, x in enumerate(lines) if x[0].isascii()])
    words = lines[n].split(" ")
    w = rng.choice([k for k, x in enumerate(words) if x.isalpha() and len(x) >= 6 and k > 0])
    k = rng.randrange(2, len(words[w]) - 2)
    lines[n] = " ".join(words[:w] + [words[w][:k] + "-"]) + "\n" + " ".join([words[w][k:], *words[w + 1 :]])
    return "\n".join(lines), n


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(5)
    texts = [page(rng) for _ in range(400)]
    counts = Counter()
    for t in texts:
        for key, n in scans.text_places(t):
            counts[key] += n
    return scans.train_editor(scans.training_examples(texts[:200]), counts), counts, texts[200:]


def decisions(editor, counts, text):
    out = {}
    for key, _ in scans.text_places(text):
        options = scans.place_candidates(key)
        best = scans_decide(editor, key, max(1, counts[key]), options, counts)
        if best is not None:
            out[key] = (options[best].at, options[best].size, options[best].put)
    return out


def scans_decide(editor, key, own, options, counts):
    return editor.decide(key, own, [tuple(counts[k] for k in c.needs) for c in options])


@pytest.mark.parametrize("kind", ["han", "word", "figure", "join"])
def test_held_out_recall_of_each_kind(trained, kind):
    editor, counts, texts = trained
    rng, hit, wrong, total = random.Random(kind), 0, 0, 0
    for t in texts:
        made = noisy(rng, t, kind)
        if made is None or made[0] == t:
            continue
        found, joined = scans.edits(made[0], decisions(editor, counts, made[0]))
        total += 1
        if kind == "join":
            hit += (made[1], made[1] + 1) in joined
            wrong += len(found)
        else:
            hit += any(e.line == made[1] for e in found)
            wrong += sum(e.line != made[1] for e in found) + len(joined)
    assert total > 100 and hit >= 0.9 * total and wrong <= 0.03 * total


def test_all_classes_are_learnt(trained):
    editor, _, _ = trained
    assert {name.split("|")[0] for name, w in editor.weights.items() if w} == {"keep", "replace", "delete", "insert", "join"}


def _tables(spark, copies=1):
    rng = random.Random(8)
    rows = [(i, page(rng), i + 3, f"d{i}") for i in range(60)]
    for i in range(60, 80):
        t = page(rng)
        for kind in ("han", "word", "figure", "join"):
            t = (noisy(rng, t, kind) or (t,))[0]
        rows.append((i, t, i + 3, f"d{i}"))
    rows = [(i + 1000 * c, t, p, d) for c in range(copies) for i, t, p, d in rows]
    hits = spark.createDataFrame(rows, "hit_id long, text string, page_start int, document_key string")
    quality = spark.createDataFrame([(f"d{i}", i + 3, "native", 0, False) for i in range(60)], "document_key string, page_number int, extraction_route string, ocr_char_count int, needs_ocr boolean")
    return hits, quality


def test_joined_decisions_equal_sent_ones(spark):
    hits, quality = _tables(spark)
    sent = set(map(tuple, scans.find_noise(hits, quality).collect()))
    joined = set(map(tuple, scans.find_noise(hits, quality, sent_decisions=0).collect()))
    assert sent == joined and {h for h, _, _ in sent} >= set(range(60, 80))
    a = {r["hit_id"]: r["repaired_text"] for r in scans.repaired_texts(hits, quality).collect()}
    b = {r["hit_id"]: r["repaired_text"] for r in scans.repaired_texts(hits, quality, sent_decisions=0).collect()}
    assert a == b and len(a) == 80


def test_same_on_repeated_data(spark):
    """Words of any frequency are judged alike: the same data again under new pages and ids gives the same lines."""
    hits, quality = _tables(spark)
    once = set(map(tuple, scans.find_noise(hits, quality).collect()))
    again = hits.unionByName(hits.select(F.col("hit_id") + 5000, F.concat("text", F.lit("\n")), "page_start", "document_key").toDF(*hits.columns))
    twice = set(map(tuple, scans.find_noise(again, quality).collect()))
    assert len({x for x in twice if x[0] < 5000} ^ once) <= 0.1 * len(once)
