"""Operator 11: every id in one place, no padding, and ids as the library gives them."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quayside.llm import histogram_packing as hp
from quayside.llm.tokenize import token_ids


def held(plan):
    return Counter({k: sum(c * p.get(k, 0) for c, p in plan) for k in {k for _, p in plan for k in p}})


@pytest.mark.parametrize("seed", range(30))
def test_patterns_and_places(seed):
    rng = random.Random(seed)
    capacity = rng.choice((16, 64, 256))
    histogram = {k: rng.choice((1, 2, 3, 7, 50, 1000)) for k in rng.sample(range(1, capacity), rng.randrange(1, min(40, capacity - 1)))}
    patterns = hp.shortest_pack_first(histogram, capacity)
    assert all(sum(k * v for k, v in p.items()) <= capacity for _, p in patterns)
    assert held(patterns) == Counter(histogram)
    plan = hp.Plan(histogram, capacity)
    cells = defaultdict(list)
    for length, n in histogram.items():
        sequence, offset, loose = plan.place(np.full(n, length), np.arange(n))
        for s, o, x in zip(sequence.tolist(), offset.tolist(), loose.tolist(), strict=True):
            for s, o, size in [(s, o, length)] if x < 0 else plan.cuts(x, length):
                cells[s].append((o, size))
    total = sum(k * v for k, v in histogram.items())
    fills = []
    for places in cells.values():
        at = 0
        for o, size in sorted(places):
            assert o == at
            at += size
        fills.append(at)
    assert sum(fills) == total and fills.count(capacity) == total // capacity
    assert all(f & (f - 1) == 0 for f in fills)


def test_longest_first_into_the_emptiest():
    # 6 opens, 5 opens, both 3s go to the pack of 5 and then to the other, the most room first
    assert hp.shortest_pack_first({6: 1, 5: 1, 3: 1, 1: 1}, 10) == [(1, {5: 1, 3: 1}), (1, {6: 1, 1: 1})]
    assert hp.shortest_pack_first({4: 5}, 10) == [(2, {4: 2}), (1, {4: 1})]


def test_words_are_encoded_as_the_library_does():
    encoder = token_ids(hp.default_path())
    rng = random.Random(5)
    signs = ["a", "Bc", "é", "1", " ", " ", " ", "\n", "\n", "\t", "'s", ".", "!", "中", "<|endoftext|>", "\U0001f600", "́", "\0", "\x85", " "]
    texts = ["", " ", "a\n\nb", *("".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(5000))]
    assert encoder.encode(texts) == [encoder._plain(t) for t in texts]


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_every_id_lies_in_one_piece(spark, broadcast):
    rng = random.Random(3)
    texts = ["", None, " \n ", "same text", "same text", "word " * 9000, *("".join(rng.choice(["Ab ", "c, ", "d\n", "<|endoftext|>", "é "]) for _ in range(rng.randrange(1, 900))) for _ in range(60))]
    rows = [(i, t, 1, 2, "x", 7) for i, t in enumerate(texts)] + [(7, "twice", 1, 2, "x", 7)] * 2 + [(None, "no id", 1, 2, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, rank long, part string, n long").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = hp.pack_by_histogram(docs, hp.default_path()).collect()
        assert hp.pack_by_histogram(docs.limit(0), hp.default_path()).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    encoder = token_ids(hp.default_path())
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = np.append(encoder._ids(text or ""), np.uint32(1)).astype("<u4")
        expected[doc_id, len(ids)] += len(ids)
        if doc_id != 7:
            mine = sorted((r.start, r.length, r.ids_crc32) for r in found if r.doc_id == doc_id)
            at = 0
            for start, length, crc in mine:
                assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
                at += length
            assert at == len(ids)
    got = Counter()
    for r in found:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
