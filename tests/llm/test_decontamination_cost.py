"""Operator 9 weighs an item's words once a worker, and counts a document once for each bucket."""

import numpy as np

from quayside.llm import decontaminate


def test_items_are_weighed_once_and_bounded(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    idf = np.random.default_rng(1).random(decontaminate.BUCKETS).astype(np.float32)
    texts = [" ".join(f"w{k}x{i % 7}" for i in range(12)) for k in range(5)]
    items = decontaminate.Items(list(range(5)), texts, idf, np.ones((decontaminate.BUCKETS, 2), np.float32))
    for k, t in enumerate(texts):
        words = decontaminate.word_hashes(t).tolist()
        assert items.holds(k, words) == (1.0, True) and items.holds(k, words[:3]) is None
        own, total = items.known[k]
        assert own == {w: float(idf[w % decontaminate.BUCKETS]) for w in words} and total == sum(own.values())
        assert len(items.known) <= 3
        assert items.weights(k, words)[0] is own


def test_document_frequencies_against_sets(spark):
    rng = np.random.default_rng(2)
    texts = ["", None, "one One ONE, one"] + [" ".join(f"w{x}" for x in rng.integers(0, 40_000, 3000)) for _ in range(5)]
    counts = decontaminate.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = np.zeros(decontaminate.BUCKETS + 1, np.int64)
    want[-1] = len(texts)
    for t in texts:
        for bucket in {h % decontaminate.BUCKETS for h in decontaminate.word_hashes(t or "").tolist()}:
            want[bucket] += 1
    assert (counts == want).all()
