"""Operator 9: benchmark passages in documents, by latent semantic retrieval.

1. Words of all documents and items as buckets, written once, and how many documents hold each bucket.
2. Randomised SVD of TF-IDF passages: tasks multiply their passages with a thin matrix, Spark adds
   the products, the driver orthonormalises ``BUCKETS`` x ``RANK`` numbers.  It is fitted on every passage of
   all documents and all items; the documents together weigh ``DOCS_WEIGHT`` of the items together, whatever the
   number of either.
3. Every document is read once (once for each ``PASS`` items of larger benchmarks): overlapping windows of about an
   item's length are projected and compared with the items, ``BLOCK`` at a time.  A window is a candidate for an item if its latent cosine, with the
   window's full length below the line, reaches ``COSINE`` of what the item has with itself:
   words that the latent space doesn't know count against a window.
4. A candidate holds if the longest common subsequence of the item's and the surrounding words
   covers ``LCS`` of the item, or ``LCS_WITH_ANSWER`` of it and the item's last sentence (its answer) is
   covered too: that catches passages with words changed, added or left out.

Only sums and verified pairs leave a task; no text is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, written

BUCKETS = 1 << 15
RANK = 64
OVERSAMPLE = 8
POWER_STEPS = 1
DOCS_WEIGHT = 0.004
#: Words of a fitted passage, and about how many words a task multiplies at once.
PASSAGE = 64
BATCH = 1 << 20
#: Passages that a task multiplies at least: their words take as much room as its sums.
TASK_PASSAGES = 1 << 16
#: Buckets whose sums are one row.
PART = 512
#: Items compared at once, and items sent to tasks at once.
BLOCK = 2_000
PASS = 50_000
#: Words of a block; windows are whole numbers of blocks.
STEP = 8
#: (blocks of a window, blocks from one window to the next); longer items double the last.
WINDOWS = ((3, 1), (5, 2), (8, 3))
COSINE = 0.4
#: Texts searched at once in a task.
CHUNK = 40
LCS, LCS_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.8
#: Items of fewer words must occur as they are.
SHORT = 8
#: Share of an item's inverse document frequencies that must be near for its words to be compared.
COVER = 0.5
#: ASCII other than letters and digits parts words.
APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().encode("utf-8", "surrogatepass").translate(APART).split()
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def bucketed(texts: DataFrame) -> DataFrame:
    """words: the buckets of each row's words, two bytes each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"words": [(word_hashes(t) % BUCKETS).astype(np.uint16).tobytes() for t in b["text"]]})

    return texts.select(text_of().alias("text")).mapInPandas(run, "words binary")


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many documents hold each bucket's words, over all rows; last, how many rows there are."""
    return bucket_counts(bucketed(docs))


def bucket_counts(words: DataFrame) -> np.ndarray:
    """The same from the documents' buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, last = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            counts[BUCKETS] += len(b)
            for raw in b["words"]:
                h = np.frombuffer(raw, np.uint16)
                at = np.arange(len(h))
                last[h] = at  # each bucket counts at one of its places only
                counts[h[last[h] == at]] += 1
        full = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": full, "n": counts[full]})

    rows = words.mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with one bit for each word of ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := at.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _project(h: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    b = h % BUCKETS
    return basis[b] * idf[b, None]


def _passages(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of about ``BATCH`` words and the weights of their passages; every text begins a passage, and what its last
    one lacks is filled up with bucket ``BUCKETS``."""
    held, weights, size = [], [], 0
    for b in batches:
        for raw, weight in zip(b["words"], b["weight"], strict=True):
            words = np.frombuffer(raw, np.uint16)
            for lo in range(0, len(words), BATCH):
                part = words[lo : lo + BATCH]
                n = -(-len(part) // PASSAGE)
                held += [part, np.full(n * PASSAGE - len(part), BUCKETS, np.uint16)]
                weights.append(np.full(n, weight, np.float32))
                size += n * PASSAGE
                if size >= BATCH:
                    yield np.concatenate(held), np.concatenate(weights)
                    held, weights, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(weights)


def _add_products(total: np.ndarray, words: np.ndarray, weights: np.ndarray, axes: np.ndarray, squares: np.ndarray) -> None:
    """Adds to each bucket's row of ``total`` the projections of the passages that hold it, once for each time."""
    rows, ones = np.empty((len(weights), axes.shape[1]), np.float32), np.ones((1, PASSAGE), np.float32)
    for lo in range(0, len(rows), PASSAGE):
        part = words[lo * PASSAGE : (lo + PASSAGE) * PASSAGE]
        rows[lo : lo + PASSAGE] = (ones @ np.take(axes, part, axis=0).reshape(-1, PASSAGE, axes.shape[1]))[:, 0]
    rows *= (weights / np.maximum(squares[words].reshape(-1, PASSAGE).sum(1), 1e-9))[:, None]
    # by bucket, so that sums run over long stretches
    order = np.argsort(words, kind="stable")[: np.count_nonzero(words < BUCKETS)]
    for lo in range(0, len(order), 1 << 12):
        at = order[lo : lo + (1 << 12)]
        b = words[at]
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        total[b[cut]] += np.add.reduceat(np.take(rows, at // PASSAGE, axis=0), cut, axis=0)


def _product(rows: DataFrame, idf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Transposed passages of all ``rows`` times the passages times ``m``."""
    sc = rows.sparkSession.sparkContext
    scaled = np.zeros((BUCKETS + 1, m.shape[1]), np.float32)
    scaled[:-1] = m * idf[:, None]
    shared = sc.broadcast((scaled, np.append(idf * idf, np.float32(0))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axes, squares = shared.value
        total = np.zeros((BUCKETS, axes.shape[1]), np.float32)
        for words, weights in _passages(batches):
            _add_products(total, words, weights, axes, squares)
        for lo in range(0, BUCKETS, PART):
            yield pd.DataFrame({"part": [lo], "m": [total[lo : lo + PART].tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["m"]), 0.0)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "m": [total.astype(np.float32).tobytes()]})

    parts = rows.mapInPandas(run, "part int, m binary").groupBy("part").applyInPandas(add, "part int, m binary").toArrow()
    out = np.zeros((BUCKETS, m.shape[1]), np.float32)
    for lo, raw in zip(parts.column("part"), parts.column("m"), strict=True):
        out[lo.as_py() : lo.as_py() + PART] = np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, m.shape[1])
    shared.destroy()
    return out * idf[:, None]


def fit_basis(docs: DataFrame, items: DataFrame, idf: np.ndarray) -> np.ndarray:
    """BUCKETS x RANK right singular vectors of the TF-IDF passages of all documents and all items, both as buckets."""
    n_docs, n_items = (df.agg(F.sum(F.ceil(F.length("words") / (2 * PASSAGE)))).first()[0] or 0 for df in (docs, items))
    rows = docs.withColumn("weight", F.lit(DOCS_WEIGHT * n_items / max(1, n_docs))).unionByName(items.withColumn("weight", F.lit(1.0)))
    # a task's sums are as large as the basis, however little it reads
    rows = rows.coalesce(max(1, min(docs.sparkSession.sparkContext.defaultParallelism, (n_docs + n_items) // TASK_PASSAGES)))
    q = np.random.default_rng(7).standard_normal((BUCKETS, RANK + OVERSAMPLE), np.float32)
    for _ in range(POWER_STEPS):
        q = orthonormal(_product(rows, idf, q))
    q = _product(rows, idf, q)
    values, vectors = np.linalg.eigh(_gram(q, q))
    return orthonormal(q @ vectors[:, np.argsort(-values)[:RANK]].astype(np.float32))


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Transposed ``a`` times ``b`` in double precision, without double copies of either."""
    return sum((a[lo : lo + 4096].T.astype(np.float64) @ b[lo : lo + 4096] for lo in range(0, len(a), 4096)), np.zeros((a.shape[1], b.shape[1])))


def orthonormal(m: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of ``m``: twice by the eigenvectors of its small Gram matrix; what
    a sample of fewer passages than columns leaves without a direction becomes zero."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(_gram(m, m))
        scale = np.where(values > 1e-10 * max(values.max(), 1e-30), 1 / np.sqrt(np.maximum(values, 1e-30)), 0.0)
        m = m @ (vectors * scale).astype(np.float32)
    return m


def _window(n_words: int) -> tuple[int, int]:
    for blocks, stride in WINDOWS:
        if n_words <= blocks * STEP:
            return blocks, stride
    blocks, stride = WINDOWS[-1]
    while n_words > blocks * STEP:
        blocks, stride = 2 * blocks, 2 * stride
    return blocks, stride


class Items:
    """Benchmark items, grouped by window: words of all in one array, vectors by group."""

    def __init__(self, ids: list, texts: list[str], idf: np.ndarray, basis: np.ndarray) -> None:
        words, answers, vectors, groups = [], [], {}, {}
        self.ids, self.idf = [], idf
        for i, t in zip(ids, texts, strict=True):
            h = word_hashes(t)
            if not len(h):
                continue
            g = _window(len(h))
            groups.setdefault(g, []).append(len(self.ids))
            self.ids.append(i)
            words.append(h)
            answers.append(next(x for s in reversed(re.split(r"[.!?\n]+", t)) if len(x := word_hashes(s))))
            # dividing by the squared latent length makes 1 of an item against itself
            v = _project(h, idf, basis).sum(0)
            vectors.setdefault(g, []).append((v * np.sqrt((idf[h % BUCKETS] ** 2).sum()) / ((v * v).sum() + 1e-9)).astype(np.float32))
        self.known: dict[int, tuple[dict[int, float], float]] = {}
        self.words, self.word_ends = _flat(words)
        self.answers, self.answer_ends = _flat(answers)
        self.groups = {g: (np.array(rows), np.array(vectors[g])) for g, rows in groups.items()}

    def weights(self, k: int, words: list[int]) -> tuple[dict[int, float], float]:
        """Inverse document frequencies of an item's words and their sum, remembered for up to ``BLOCK`` items."""
        if k not in self.known:
            if len(self.known) >= BLOCK:
                self.known.clear()
            own = {w: float(self.idf[w % BUCKETS]) for w in words}
            self.known[k] = own, sum(own.values())
        return self.known[k]

    def holds(self, k: int, near: list[int]) -> tuple[float, bool] | None:
        words = self.words[self.word_ends[k] : self.word_ends[k + 1]].tolist()
        if len(words) < SHORT:
            n = len(words)
            return (1.0, True) if any(near[i : i + n] == words for i in range(len(near) - n + 1)) else None
        own, total = self.weights(k, words)
        if sum(map(own.__getitem__, own.keys() & set(near))) < COVER * total:
            return None
        share = lcs_length(words, near) / len(words)
        if share < LCS_WITH_ANSWER:
            return None
        ending = self.answers[self.answer_ends[k] : self.answer_ends[k + 1]].tolist()
        answer = lcs_length(ending, near) >= ANSWER * len(ending)
        return (share, answer) if share >= LCS or answer else None

    def search(self, texts: list[str], axes: np.ndarray) -> list[list[tuple]]:
        """(item_id, cosine, lcs, answer) of the items that each text holds; ``axes`` is the basis times ``idf``."""
        idf, hashes = self.idf, [word_hashes(t) for t in texts]
        sizes = np.array([-(-len(h) // STEP) for h in hashes])
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        found: list[dict] = [{} for _ in texts]
        if not total:
            return [[] for _ in texts]
        sums, mass = np.zeros((total + 1, axes.shape[1]), np.float32), np.zeros(total + 1, np.float32)
        for h, size, end in zip(hashes, sizes, ends, strict=True):
            for lo in range(0, size, 4096):  # bounds the memory of very long texts
                part = h[lo * STEP : (lo + 4096) * STEP] % BUCKETS
                w, cuts = idf[part], np.arange(0, len(part), STEP)
                at = end - size + lo + 1
                sums[at : at + len(cuts)] = np.add.reduceat(axes[part], cuts, axis=0)
                mass[at : at + len(cuts)] = np.add.reduceat(w * w, cuts)
        np.cumsum(sums, axis=0, out=sums)
        np.cumsum(mass, out=mass)
        doc = np.repeat(np.arange(len(texts)), sizes)
        inside = np.arange(total) - (ends - sizes)[doc]
        for (m, stride), (rows, vectors) in self.groups.items():
            # a window every ``stride`` blocks, none that begins where the one before already ends with the text
            starts = np.flatnonzero((inside % stride == 0) & ((inside == 0) | (inside - stride + m < sizes[doc])))
            stops = np.minimum(starts + m, ends[doc[starts]])
            windows = (sums[stops] - sums[starts]) / np.sqrt(np.maximum(mass[stops] - mass[starts], 1e-3))[:, None]
            for lo in range(0, len(rows), BLOCK):
                cosines = windows @ vectors[lo : lo + BLOCK].T
                at, which = np.nonzero(cosines >= COSINE)
                value = cosines[at, which]
                tried: dict[tuple[int, int], list[int]] = {}
                best = np.argsort(-value, kind="stable")
                for d, k, first, cosine in zip(doc[starts[at[best]]].tolist(), rows[lo + which[best]].tolist(), inside[starts[at[best]]].tolist(), value[best].tolist(), strict=True):
                    near_by = tried.setdefault((d, k), [])
                    # what was compared around a window holds the windows up to half its length away
                    if k in found[d] or any(abs(first - x) <= m // 2 for x in near_by):
                        continue
                    near_by.append(first)
                    near = hashes[d][max(0, first - m // 2 - 1) * STEP : (first + m + m // 2 + 1) * STEP].tolist()
                    if held := self.holds(k, near):
                        found[d][k] = (float(cosine), *held)
        return [[(self.ids[k], *v) for k, v in sorted(f.items())] for f in found]


def _flat(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, arrays)])
    return (np.concatenate(arrays) if arrays else np.zeros(0, np.int64)), ends


def _searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """For each ``PASS`` items, a function from texts to what they hold, for use in tasks."""
    spark = docs.sparkSession
    words = written(bucketed(docs), "lsa-documents")
    counts = bucket_counts(words)
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])).astype(np.float32) + np.float32(1e-3)
    basis = fit_basis(words, written(bucketed(benchmark), "lsa-items"), idf)
    axes = spark.sparkContext.broadcast(basis * idf[:, None])
    passes = max(1, -(-benchmark.count() // PASS))
    for k in range(passes):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).select("item_id", text_of().alias("text")).toArrow()
        items = spark.sparkContext.broadcast(Items(part.column("item_id").to_pylist(), part.column("text").to_pylist(), idf, basis))

        def search(texts: list[str], items=items) -> Iterator[list[tuple]]:
            for lo in range(0, len(texts), CHUNK):
                yield from items.value.search(texts[lo : lo + CHUNK], axes.value)

        yield search


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer: each benchmark item that a document holds.

    Null and empty texts hold nothing and empty items are held by nothing; repeated rows repeat
    their pairs; a null doc_id is searched and reported as null; other columns are ignored.
    """
    schema = "doc_id string, item_id long, cosine double, lcs double, answer boolean"
    found = None
    for search in _searchers(docs, benchmark):

        def run(batches: Iterator[pd.DataFrame], search=search) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(d, *r) for d, held in zip(b["doc_id"], search(b["text"].tolist()), strict=True) for r in held]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "lcs", "answer"])

        one = docs.select(F.col("doc_id").cast("string"), text_of().alias("text")).mapInPandas(run, schema)
        found = one if found is None else found.unionByName(one)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, decided row by row: nothing is joined."""

    def clean(search) -> F.Column:
        @F.pandas_udf("boolean")
        def holds_nothing(text: pd.Series) -> pd.Series:
            return pd.Series([not held for held in search(text.tolist())], dtype=bool)

        return holds_nothing(text_of())

    for column in [clean(search) for search in _searchers(docs, benchmark)]:
        docs = docs.where(column)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
