"""The pipeline's near stage takes candidates from operator 6's fingerprints and Golay-code keys."""

import numpy as np

from quayside.llm import near_dup, simhash


def test_near_stage_links_by_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 3000)]
    texts = [" ".join(base), " ".join([*base, "one", "more"]), " ".join(base[:1500]), " ".join(f"v{x}" for x in range(3000)), "a b", "", " "]
    fps = [simhash.fingerprint(s) for s in near_dup._sets({"text": texts}, 5)]
    assert 0 < (fps[0] ^ fps[1]).bit_count() <= 2
    # without bands only operator 6 names candidates
    monkeypatch.setattr(near_dup, "band_keys", lambda shingles, multipliers: [])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline._near(spark, docs, "").collect()) == [0, 2, 3, 4, 5]


def test_candidates_of_fingerprints_are_verified(spark):
    """Nodes of one fingerprint or of near ones are pairs; what is not similar is no link."""
    words = lambda at: " ".join(f"w{at}x{i}" for i in range(30))
    docs = spark.createDataFrame([(i, words(i)) for i in range(4)], "doc_id long, text string")
    rows = near_dup._signatures(docs, 5, 0.8).withColumnRenamed("doc_id", "node").collect()
    nodes = spark.createDataFrame([(r.node, r.rid, r.rid2, r.n, fp, r.keys) for r, fp in zip(sorted(rows, key=lambda r: r.node), (5, 5, 7, 1 << 40), strict=True)],
                                  "node long, rid long, rid2 long, n long, fp long, keys array<long>")
    assert {(r.a, r.b) for r in near_dup._fuzzy_pairs(nodes).collect()} == {(0, 1), (0, 2)}
    assert near_dup.near_links(nodes, docs, 5, 0.8).count() == 0
