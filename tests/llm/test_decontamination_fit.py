"""Operator 9's latent space comes from every passage of all documents and all items."""

import numpy as np
import pandas as pd
import pytest

from quayside.llm import decontaminate


@pytest.fixture(scope="module")
def late(spark):
    """Items of words of their own after 2,000 others, each in one document of 3,000, and the documents that hold them."""
    rng = np.random.default_rng(4)
    common = [" ".join(f"i{x}" for x in rng.integers(0, 40, 12)) for _ in range(2000)]
    own = [" ".join(f"own{k}word{j}" for j in range(20)) for k in range(50)]
    texts = [" ".join(f"c{x}" for x in rng.integers(0, 40, 10)) for _ in range(3000)]
    held = {60 * k + 7: k for k in range(50)}
    docs = [(d, own[held[d]] if d in held else t) for d, t in enumerate(texts)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(common + own)), "item_id long, text string"), {(d, 2000 + k) for d, k in held.items()}


def test_words_of_late_items_in_few_documents(late):
    """no sample of documents or items leaves words unknown."""
    docs, items, want = late
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == want


def test_documents_with_late_items_are_dropped(late):
    """the same in the pipeline's stage."""
    docs, items, want = late
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == set(range(3000)) - {d for d, _ in want}


def test_products_against_a_dense_matrix(monkeypatch):
    """Every passage counts with its weight, in batches of any size, long texts and empty ones too."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 900, n).astype(np.uint16) for n in (0, 1, 64, 65, 3000, 20, 0, 129)]
    weights = rng.random(len(texts)).astype(np.float32)
    idf, m = rng.random(decontaminate.BUCKETS + 1).astype(np.float32) + 0.1, rng.standard_normal((decontaminate.BUCKETS + 1, 5)).astype(np.float32)
    idf[-1], m[-1] = 0, 0
    want = np.zeros((decontaminate.BUCKETS, 5))
    for t, weight in zip(texts, weights, strict=True):
        for lo in range(0, len(t), decontaminate.PASSAGE):
            row = np.bincount(t[lo : lo + decontaminate.PASSAGE], minlength=decontaminate.BUCKETS + 1) * idf.astype(float)
            mass = (idf[t[lo : lo + decontaminate.PASSAGE]].astype(float) ** 2).sum()
            want += weight / mass * np.outer(row, row @ m)[:-1]
    for batch in (64, 192, 1 << 20):
        monkeypatch.setattr(decontaminate, "BATCH", batch)
        total = np.zeros((decontaminate.BUCKETS, 5), np.float32)
        for words, by_passage in decontaminate._passages([pd.DataFrame({"words": [t.tobytes() for t in texts[:3]], "weight": weights[:3]}), pd.DataFrame({"words": [t.tobytes() for t in texts[3:]], "weight": weights[3:]})]):
            decontaminate._add_products(total, words, by_passage, m * idf[:, None], idf * idf)
        assert np.allclose(total * idf[:-1, None], want, rtol=1e-4, atol=1e-5)
