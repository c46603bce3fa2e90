"""Operator 1: toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, of toxic and of ordinary documents, share what rare
expressions fall back to: the weight of a context's fallback and the lowest order come from
continuation counts over both classes.  Between word and base lies the word's stem, so that
inflections are smoothed through their stem's counts.  Discounts are large, so that an expression
seen a few times has the shared probability in both classes.

Each token has a log-likelihood ratio.  What the mix of languages and topics in the two
classes does to it stays below ``MARGIN`` and is taken off; the document's evidence is the
logarithm of the remaining sum, normalised by the document's length with an exponent that a logistic
curve learns, together with its shift, from labelled documents that the counts haven't seen.

The models are fitted on at most ``FIT_DOCS`` labelled documents of each class (the smallest by a
hash of doc_id), whole texts of them.  Tasks receive every word, stem and bigram whose counts exceed its discount;
the others have their fallback's ratio exactly, so leaving them out changes no score.  Every whole
document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, written

FIT_DOCS = 8_000
#: Counts taken off a word, a stem and a bigram for their fallbacks.
WORD_DISCOUNT, STEM_DISCOUNT, PAIR_DISCOUNT = 4.0, 8.0, 4.0
#: Log ratio of a token that counts as none.
MARGIN = 2.0
STEM = 4
#: Of crc32(doc_id as text) mod FOLDS: fold 0 is held out, CALIBRATION fits the curve, the rest the counts.
FOLDS, CALIBRATION = 5, 1
#: Distinct expressions counted in a task before they are passed on.
COUNTED = 60_000
#: Words that a Python worker remembers the rows of; then the memory is emptied.
REMEMBERED = 200_000
#: Seed of Spark's xxhash64, which names words.
SEED = 42
WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fold(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


class Rows(dict):
    """Row of each word in a model's ``llr``, looked up by hash and remembered up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        m, first = self.model, len(self.model.words)
        at = _place(m.words, word)
        if at < 0:
            stem = _place(m.stems, word[:STEM])
            at = first + (stem if stem >= 0 else len(m.stems))
        self[word] = at
        return at


def _place(keys: np.ndarray, word: str) -> int:
    key = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), SEED)
    key -= (key >> 63) << 64
    at = int(np.searchsorted(keys, key))
    return at if at < len(keys) and keys[at] == key else -1


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the words
    stems: np.ndarray  # sorted hashes of the stems
    llr: np.ndarray  # log ratios of the words, of the stems, and of what has no known stem
    pairs: np.ndarray  # sorted row of context * number of words + row of word
    pair_llr: np.ndarray
    curve: tuple = (1.0, -1.0, 0.0)  # weights of excess, of length, shift
    rows: Rows | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": None}

    def ratios(self, seq: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each token in its context."""
        if self.rows is None:
            self.rows = Rows(self)
        n = len(self.words)
        at = np.fromiter(map(self.rows.__getitem__, seq), np.int64, len(seq))
        llr = self.llr[at]
        if len(self.pairs) and len(seq) > 1:
            key = np.where((at[:-1] < n) & (at[1:] < n), at[:-1] * n + at[1:], -1)
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            llr[1:] = np.where(self.pairs[place] == key, self.pair_llr[place], llr[1:])
        return llr

    def evidence(self, text: str) -> tuple[float, float]:
        """Logarithms of the tokens' excess log ratio and of their number."""
        seq = tokens(text)
        if not seq:
            return 0.0, 0.0
        return float(np.log1p(np.maximum(self.ratios(seq) - MARGIN, 0).sum(dtype=np.float64))), float(np.log1p(len(seq)))

    def score(self, text: str) -> float:
        excess, length = self.evidence(text)
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * excess + b * length + c, -30, 30))))


def fit_rows(labels: DataFrame, limit: int = FIT_DOCS) -> DataFrame:
    """doc_id, toxic, fold: at most ``limit`` labelled rows of each class outside the held-out fold.

    A doc_id that is labelled twice counts as toxic if any of its labels says so.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold()).where("fold <> 0")
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def gram_counts(docs: DataFrame) -> DataFrame:
    """v (null for single words), w, n0, n1: counts by class of documents (text, toxic)."""

    def frame(counts: Counter) -> pd.DataFrame:
        rows = [(v, w, n * (c == 0), n * (c == 1)) for (c, v, w), n in counts.items()]
        return pd.DataFrame(rows, columns=["v", "w", "n0", "n1"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for text, c in zip(b["text"], b["toxic"], strict=True):
                seq = tokens(text)
                counts.update((c, None, w) for w in seq)
                counts.update((c, v, w) for v, w in zip(seq, seq[1:], strict=False))
                if len(counts) > COUNTED:
                    yield frame(counts)
                    counts = Counter()
        yield frame(counts)

    rows = docs.select(text_of().alias("text"), F.col("toxic").cast("int").alias("toxic")).mapInPandas(run, "v string, w string, n0 long, n1 long")
    return rows.groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(docs: DataFrame) -> Model:
    """The two models of documents (text, toxic), as log ratios.

    Spark counts, smooths and divides; the driver gets hashes and ratios alone, in Arrow batches."""
    counts = written(gram_counts(docs), "toxic-counts")
    pairs, single = counts.where("v is not null"), counts.where("v is null").drop("v")
    context = pairs.groupBy(F.col("v").alias("w")).agg(F.count("*").alias("after"))
    left = pairs.groupBy("w").agg(F.count("*").alias("cont"))
    words = single.join(context, "w", "left").join(left, "w", "left").fillna(0)
    words = written(words.withColumn("stem", F.substring("w", 1, STEM)), "toxic-words")
    by_stem = words.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "cont")])
    freed = lambda c, d: F.coalesce(F.sum(F.least(F.col(c), F.lit(d))), F.lit(0.0)).alias(f"free_{c}")
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "cont")], freed("n0", WORD_DISCOUNT), freed("n1", WORD_DISCOUNT)).first()
    stem_total = by_stem.agg(freed("n0", STEM_DISCOUNT), freed("n1", STEM_DISCOUNT), F.count("*").alias("n")).first()
    n = [max(1, total["n0"]), max(1, total["n1"])]
    lam = [max(1.0, total[f"free_n{c}"]) / n[c] for c in (0, 1)]
    lam_stem = [max(1.0, stem_total[f"free_n{c}"]) / n[c] for c in (0, 1)]
    base_total = total["cont"] + stem_total["n"] + 1
    beyond = lambda c, d: F.greatest(F.col(c) - d, F.lit(0.0))
    ratio = lambda one, none: F.log(F.col(one) / F.col(none)).cast("float").alias("llr")
    known = lambda d: F.greatest("n0", "n1") > d

    base = (F.col("cont") + 1) / F.lit(float(base_total))  # continuation share of a stem, both classes together
    stems = by_stem.select("stem", "n0", "n1", "cont", *[(lam[c] * (beyond(f"n{c}", STEM_DISCOUNT) / n[c] + lam_stem[c] * base)).alias(f"s{c}") for c in (0, 1)])
    share = (F.col("cont") + 1) / (F.col("stem_cont") + F.col("cont") + 2)
    smooth = words.where(known(WORD_DISCOUNT)).join(stems.select("stem", F.col("cont").alias("stem_cont"), "s0", "s1"), "stem")
    smooth = smooth.select("w", "n0", "n1", "after", *[(beyond(f"n{c}", WORD_DISCOUNT) / n[c] + F.col(f"s{c}") * share).alias(f"p{c}") for c in (0, 1)])
    smooth = written(smooth, "toxic-smooth")
    back = F.least(F.lit(1.0), PAIR_DISCOUNT * F.col("after") / (F.col("v0") + F.col("v1")))
    often = pairs.where(known(PAIR_DISCOUNT)).join(smooth.select("w", "p0", "p1"), "w")
    often = often.join(smooth.select(F.col("w").alias("v"), F.col("n0").alias("v0"), F.col("n1").alias("v1"), "after"), "v")
    often = often.select("v", "w", *[(beyond(f"n{c}", PAIR_DISCOUNT) / F.greatest(f"v{c}", F.lit(1)) + back * F.col(f"p{c}")).alias(f"q{c}") for c in (0, 1)])

    w = smooth.select(F.xxhash64("w").alias("key"), ratio("p1", "p0")).toArrow()
    s = stems.where(known(STEM_DISCOUNT)).select(F.xxhash64("stem").alias("key"), ratio("s1", "s0")).toArrow()
    p = often.select(F.xxhash64("v").alias("v"), F.xxhash64("w").alias("w"), ratio("q1", "q0")).toArrow()
    word_keys, word_llr = _sorted(_numpy(w, "key"), _numpy(w, "llr"))
    stem_keys, stem_llr = _sorted(_numpy(s, "key"), _numpy(s, "llr"))
    at = np.searchsorted(word_keys, _numpy(p, "v")) * max(1, len(word_keys)) + np.searchsorted(word_keys, _numpy(p, "w"))
    pair_keys, pair_llr = _sorted(at, _numpy(p, "llr"))
    unknown = np.log(lam[1] * lam_stem[1] / (lam[0] * lam_stem[0]))
    return Model(word_keys, stem_keys, np.concatenate((word_llr, stem_llr, [unknown])).astype(np.float32), pair_keys, pair_llr)


def _numpy(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def calibrate(model: Model, seen: np.ndarray, toxic: np.ndarray) -> Model:
    """Fits the logistic curve by Newton steps; a small penalty keeps separable data finite.
    With one class only, the curve says ordinary, or toxic, for every document."""
    if len(set(toxic.tolist())) < 2:
        model.curve = (0.0, 0.0, 5.0 if len(toxic) and toxic[0] == 1 else -5.0)
        return model
    mean, spread = seen.mean(0), seen.std(0) + 1e-9
    x = np.column_stack(((seen - mean) / spread, np.ones(len(seen))))
    beta = np.zeros(3)
    ridge = np.diag([1e-2, 1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (toxic - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    a, b = beta[:2] / spread
    model.curve = (float(a), float(b), float(beta[2] - a * mean[0] - b * mean[1]))
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> Model:
    """Counts from folds 2 to 4, the curve from fold 1; both from at most ``limit`` rows of each class."""
    chosen = F.broadcast(fit_rows(labels, limit))  # at most 2 * limit rows
    rows = written(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic", "fold"), "toxic-fit")
    model = fit(rows.where(F.col("fold") != CALIBRATION))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            excess, length = np.array([shared.value.evidence(t) for t in b["text"]]).reshape(-1, 2).T
            yield pd.DataFrame({"excess": excess, "length": length, "toxic": b["toxic"]})

    seen = rows.where(F.col("fold") == CALIBRATION).select(text_of().alias("text"), F.col("toxic").cast("int").alias("toxic"))
    seen = seen.mapInPandas(run, "excess double, length double, toxic int").toArrow()
    shared.destroy()
    return calibrate(model, np.column_stack((_numpy(seen, "excess"), _numpy(seen, "length"))), _numpy(seen, "toxic"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null text counts as empty and gets the score of no evidence; repeated rows repeat their
    score; a null doc_id is not held out.  Only the text is an input of a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [shared.value.score(t) for t in b["text"]]})

    scored = docs.select(F.col("doc_id").cast("string"), text_of().alias("text")).mapInPandas(run, "doc_id string, score double")
    scored = scored.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))).withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the models trained on ``labels`` call toxic."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def ordinary(text: pd.Series) -> pd.Series:
        return text.map(lambda t: shared.value.score(t) < 0.5)

    return docs.where(ordinary(text_of()))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
