"""Operator 13 against every period tried at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quayside.llm import periodic_runs as pr


def plain_runs(w):
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            part = w[start : start + length]
            smallest = next(p for p in range(1, q + 1) if all(part[k] == part[k + p] for k in range(length - p)))
            if length >= max(24, 3 * q) and smallest == q:
                found.append([start, length, q])
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(text, doc_id):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = [None] * 4
    for s, length, q in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = [s, length, q, 1000 * length // q]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(runs), *best, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped))


def texts(seed, count):
    """Random words with repeats of repeats, over alphabets of all sizes."""
    rng = random.Random(seed)
    for _ in range(count):
        letters, w = rng.choice((1, 2, 3, 50)), []
        while len(w) < rng.choice((5, 30, 90, 200)):
            part = [rng.randrange(letters) for _ in range(rng.randrange(1, 12))] * rng.choice((1, 1, 2, 3, 4, 9))
            if rng.random() < 0.3:
                part = (part + [rng.randrange(letters)]) * rng.randrange(2, 5)
            w += part
        yield [f"w{x}".encode() for x in w]


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_all_periods(seed):
    for w in texts(seed, 80):
        expected = plain_runs(w)
        names = {}
        assert pr.runs_of([names.setdefault(x, len(names)) for x in w]).tolist() == expected
        assert pr.text_runs(w).tolist() == expected


def test_extensions_against_comparison():
    rng = random.Random(4)
    for _ in range(40):
        s = [rng.randrange(rng.choice((1, 2, 4))) for _ in range(rng.randrange(2, 60))]
        tree, n = pr.SuffixTree(s), len(s)
        pairs = [(a, b) for a in range(n) for b in range(n + 1) if a != b]
        got = pr.SuffixTree.extension(tree, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        for (a, b), k in zip(pairs, got.tolist(), strict=True):
            most = n - max(a, b)
            assert k == next((x for x in range(most) if s[a + x] != s[b + x]), most)
        order = sorted(range(n + 1), key=lambda i: s[i:])
        assert [tree.ranks[i] for i in order] == list(range(n + 1))
        order = sorted(range(n + 1), key=lambda i: [-x for x in s[i:]])
        assert [tree.reversed_ranks()[i] for i in order] == list(range(n + 1))


def test_query_against_plain_code(spark):
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, " \n "), (3, "a " * 23), (4, "a " * 24), (5, "a b " * 3000), (6, "é中 x y z " * 40), (7, "twice " * 30), (7, "twice " * 30), (None, "no id " * 30), (-10, "x y z " * 9)]
    rows += [(100 + i, " ".join(x.decode() for x in w)) for i, w in enumerate(texts(77, 60))]
    rows += [(i, "\n".join(" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 30))) for _ in range(9))) for i in range(1000, 1080)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, start long, n_runs long, period string").repartition(3)
    got = sorted(map(tuple, pr.periodic_runs(docs, pr.planted).collect()), key=repr)
    assert got == sorted(((i, *plain_row(t, i)) for i, t in rows), key=repr)
    assert pr.periodic_runs(docs.limit(0), pr.planted).count() == 0


def test_whole_table_against_plain_code(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = {r.doc_id: plain_row(r.text, r.doc_id) for r in docs.collect() if len(r.text or "") < 9000}
    got = {r[0]: tuple(r[1:]) for r in pr.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert {k: got[k] for k in expected} == expected and sum(r[0] > 0 for r in expected.values()) > 5
