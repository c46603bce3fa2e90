"""Operator 6: SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  If two fingerprints differ
in at most two bits, then in one of the three neighbouring pairs of segments the first is
equal and the second differs in at most one bit.  The second, as a word of 23 bits, is decoded with
the binary Golay code (23, 12): its key is the codeword within three bits and, where that is
three bits away, also the five codewords four bits away.  Words one bit apart always share
such a key, so (pair, exact bits, codeword index) finds every link; candidates are verified.

Keys with more than ``HOT`` fingerprints don't pair them up.  Their fingerprints are instead
linked through the 65 words within one bit of each: two are linked exactly if they share such
a word, and each word's fingerprints are tied to its smallest one, so rows stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, hot_join, table, text_of, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints of one key that are paired up directly.
HOT = 64
#: (shift, bits) of the segments; the second of a pair is the next one, cyclically.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: Values of the bits of a fingerprint.
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str, k: int = SHINGLE) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(joined, SEED)]
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends)]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)]


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of unsigned shingle hashes, as a signed integer; zero of none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(BITS[ones * 2 > len(hashes)].sum(dtype=np.uint64).astype(np.int64))


def fingerprints(texts: list[str]) -> np.ndarray:
    """A 64-bit fingerprint for each text, as signed integers."""
    return np.fromiter((fingerprint(np.array(shingle_hashes(t), np.uint64)) for t in texts), np.int64, len(texts))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome the nearest error
    (weight up to 3) and, if it weighs 3, the five errors of weight 4 (else zeros)."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    single = [remainder(1 << b) for b in range(23)]
    syndrome = lambda bits: int(np.bitwise_xor.reduce([single[b] for b in bits])) if bits else 0
    low = np.array([syndrome([b for b in range(12) if v >> b & 1]) for v in range(1 << 12)], np.int64)
    high = np.array([syndrome([12 + b for b in range(11) if v >> b & 1]) for v in range(1 << 11)], np.int64)
    near, far, filled = np.zeros(1 << 11, np.int64), np.zeros((1 << 11, 5), np.int64), np.zeros(1 << 11, np.int64)
    third = np.zeros(1 << 11, bool)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s, e = syndrome(bits), sum(1 << b for b in bits)
            if weight < 4:
                near[s], third[s] = e, weight == 3
            elif third[s]:
                far[s, filled[s]] = e
                filled[s] += 1
    return low, high, near, far


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices of 23-bit words and which of them count."""
    low, high, near, far = _golay()
    s = low[words & 0xFFF] ^ high[words >> 12]
    errors = np.column_stack((near[s], far[s]))
    counts = errors != 0
    counts[:, 0] = True
    return (words[:, None] ^ errors) >> 11, counts


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of signed fingerprints: (row numbers, keys)."""
    u = fp.view(np.uint64)
    cut = [((u >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        index, counts = golay_keys(cut[(i + 1) % 3])
        r, c = np.nonzero(counts)
        rows.append(r)
        keys.append((i << 40) | (cut[i][r] << 12) | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, fp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fingerprints(b["text"].tolist())})

    return docs.select(F.col("doc_id").cast("string"), text_of().alias("text")).mapInPandas(run, "doc_id string, fp long").select(F.col("doc_id").cast("long"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of the column ``fp`` (distinct) that differ in at most two bits."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            rows, key = fuzzy_keys(fp)
            yield pd.DataFrame({"key": key, "fp": fp[rows]})

    keyed = fps.select("fp").mapInPandas(keys, "key long, fp long")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(hot_join(keyed, written(counts, "simhash-counts"), ["key"], "n"), "simhash-keys")
    cold = shared.where(F.col("n") <= HOT).select("key", "fp")
    a, b = cold.select("key", F.col("fp").alias("a")), cold.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = a.join(b, "key").where("a < b").where(near).select("a", "b").distinct()
    hot = shared.where(F.col("n") > HOT).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    around = hot.select("fp", F.explode(flips).alias("word"))
    least = around.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("word", "b")
    tied = around.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(tied)


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    One row for each row of ``docs``.  Null text counts as empty; texts without words have
    fingerprint zero and link like any other; other columns are ignored.  Repeated rows share
    a fingerprint and so a component.  A row without doc_id is linked too, but never names a
    component unless no other row does (then it is null).
    """
    sigs = written(signatures(docs), "simhash-sigs")
    fps = written(sigs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-fps")
    roots = connected_components(links(fps), "simhash-cc")
    grouped = fps.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    place = written(fps.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "simhash-place")
    return hot_join(sigs, place, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id.

    Rows that repeat a doc_id stay together; rows without doc_id are kept.
    """
    found = simhash_components(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    # always a merge join: a broadcast of what goes would have no bound
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
