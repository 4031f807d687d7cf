import random

import numpy as np
import pytest

from vellum.llm import leaks

LETTERS = {"en": "abcdefghijklmnopqrstuvwxyz", "zh": "".join(chr(0x4E00 + i) for i in range(2500))}


def exchanged(rng, text, rule, letters, words):
    """The text with so many words exchanged for others, left out or put in."""
    for _ in range(words):
        at = rng.randrange(rule.edge, len(text) - rule.word - rule.edge)
        old, new = rng.randint(0, rule.word), rng.randint(0, rule.word)
        text = text[:at] + "".join(rng.choices(letters, k=new)) + text[at + old :]
    return text


@pytest.mark.parametrize("lang", ["zh", "en"])
def test_no_stretch_within_the_budget_is_lost(spark, lang):
    """Random stretches of the shortest length with the whole budget spent, anywhere in random documents."""
    rng, rule, letters = random.Random(4), leaks.RULES[lang], LETTERS[lang]
    text = lambda n: "".join(rng.choices(letters, k=n))
    items = [(i, lang, text(rng.randint(2 * rule.stretch, 4 * rule.stretch))) for i in range(20)]
    docs, want = [], set()
    for k in range(150):
        i, _, t = rng.choice(items)
        a = rng.randrange(0, len(t) - rule.stretch)
        docs.append((k, text(rng.randint(0, 200)) + exchanged(rng, t[a : a + rule.stretch], rule, letters, rule.words) + text(rng.randint(0, 200))))
        want.add((k, i))
    docs += [(1000 + k, text(900)) for k in range(50)]
    got = {tuple(r) for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, lang string, text string")).collect()}
    assert len(got & want) >= 0.98 * len(want) and got <= want


@pytest.mark.parametrize("lang", ["zh", "en"])
def test_filter_bound_holds(lang):
    """The lemma's bound: every such stretch leaves that many sampled q-grams in one band (the filter alone)."""
    rng, rule, letters = random.Random(9), leaks.RULES[lang], LETTERS[lang]
    table = leaks.letter_table()
    text = lambda n: "".join(rng.choices(letters, k=n))
    for _ in range(300):
        item = text(2 * rule.stretch)
        a = rng.randrange(0, rule.stretch)
        doc = leaks._letters(text(rng.randint(0, 60)) + exchanged(rng, item[a : a + rule.stretch], rule, letters, rule.words) + text(30), table)
        index = leaks.Index(rule, [7], [leaks._letters(item, table)])
        d, _, _ = index.candidates(doc, np.zeros(len(doc), np.int64), np.zeros(1, np.int64))
        assert len(d)


def test_long_documents_and_many_items(spark):
    """Memory follows the hits, not documents times items; blocks of items give the same as one block."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices(LETTERS["en"], k=n))
    items = [(i, "en", text(200)) for i in range(400)]
    docs = [(k, text(80)) for k in range(800)] + [(9000, text(100_000) + items[5][2] + text(100_000)), (9001, items[399][2])]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, lang string, text string")
    want = {(9000, 5), (9001, 399)}
    assert {tuple(r) for r in leaks.find_leaks(d, e).collect()} == want
    assert {tuple(r) for r in leaks.find_leaks(d, e, item_letters=30_000).collect()} == want
