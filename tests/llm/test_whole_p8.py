import random

from vellum.llm import leaks


def test_an_item_over_two_blocks_is_searched_whole(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(90))
    texts = sorted(text() for _ in range(3))
    items = spark.createDataFrame([(1, "en", texts[0]), (1, None, texts[1]), (1, "en", texts[2]), (2, "en", text())], "item_id long, lang string, text string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {tuple(r) for r in leaks.find_leaks(docs, items, item_letters=900).collect()} == {(0, 1), (1, 1), (2, 1)}
