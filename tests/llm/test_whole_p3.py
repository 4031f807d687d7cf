from vellum.llm import scans


def test_a_frequent_misreading_is_restored():
    """How often a misreading stands in the texts is no gate: the trained editor looks at the ratio."""
    words = ["profit", "market", "income", "number", "period", "future"]
    counts = {"w" + w: 50_000 for w in words} | {"wpr0fit": 3000, "wmaiket": 10, "wnurnber": 2500}
    stay = [("w" + w, None) for w in words]
    put_in = [(f"w{w[:k]}{wrong}{w[k + len(right):]}", w) for w in words for wrong, right in scans.MISREAD_LATIN for k in range(len(w)) if w.startswith(right, k)]
    editor = scans.train_editor(stay + put_in, counts)
    for bad, right in (("pr0fit", "profit"), ("nurnber", "number")):
        options = scans.place_candidates("w" + bad)
        best = editor.decide("w" + bad, counts["w" + bad], [tuple(counts.get(k, 0) for k in c.needs) for c in options])
        assert best is not None and options[best].needs == ("w" + right,)
    assert editor.decide("wprofit", 50_000, [tuple(counts.get(k, 0) for k in c.needs) for c in scans.place_candidates("wprofit")]) is None
