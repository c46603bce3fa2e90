"""Operator 7: quality by a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Every document's unigrams and bigrams are hashed into a fixed number of buckets.  Two
multinomials over the buckets, of trusted-target documents and of the whole raw corpus,
give each bucket a log ratio; a document's score is the mean ratio over its n-grams
(length-normalised), and it is kept if the score reaches a threshold.  All labelled rows and all
documents count, nothing is sampled: the same tables give the same verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import exact_quantiles
from .common import SPACES, table, text_of, written

BUCKETS = 1 << 16
#: Pseudo-count of every bucket.
PRIOR = 0.5
#: Log ratios are whole multiples of 1/UNIT, so their sums are exact and don't depend on the order of rows.
UNIT = 1 << 24
#: Share of the trusted documents' scores below which the threshold may not cut.
TRUSTED_TAIL = 0.005
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+", -1))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: Spark would inline it at every use in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column, n: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash; only texts with two equal hashes get sorted.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), n - 5),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]),
    )

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return _let(ranked, lambda r: _let(F.sort_array(twice(r)), union_size))

    def twice(r: Column) -> Column:
        equal = lambda s, j: F.coalesce(F.get(r, j)["x"] == s["x"], F.lit(False))
        return F.filter(F.transform(r, lambda s, j: F.when(equal(s, j - 1) | equal(s, j + 1), s["i"])), lambda p: p.isNotNull())

    def union_size(starts: Column) -> Column:
        zero = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(
            starts,
            zero,
            lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(5), p - a["last"])).alias("total")),
        )["total"]

    bound = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n < 5, F.lit(0).cast("long")).otherwise(bound)


def rule_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    whole = text_of(text)
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumn("words", words_of(whole))
    out = out.withColumn("n_words", F.size("words").cast("long"))
    out = (
        out.withColumn("word_chars", F.length(F.translate(whole, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", _repeated_words(F.col("words"), F.size("words")))
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _positions(docs: DataFrame, *keep: str) -> DataFrame:
    """One row for each word, with the buckets of the word and of the word and its successor."""
    pairs = F.arrays_zip(F.col("words").alias("w"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("v"))
    at = docs.select(*keep, F.explode_outer(pairs).alias("g"))
    return at.select(
        *keep,
        F.when(F.col("g.w").isNotNull(), _bucket(F.col("g.w"))).alias("b1"),
        F.when(F.col("g.v").isNotNull(), _bucket(F.col("g.w"), F.col("g.v"))).alias("b2"),
    )


def _fit_rows(labels: DataFrame) -> DataFrame:
    """All labelled rows; a document with both labels counts as rejected."""
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("fit_label"))


def ratio_table(worded: DataFrame) -> DataFrame:
    """bucket, llr (in units of 1/UNIT) over all buckets seen: target rows are those with fit_label 1, raw are all."""
    at = _positions(worded, "fit_label")
    target = F.when(F.col("fit_label") == 1, 1).otherwise(0).alias("t")
    grams = at.select(F.explode(F.array("b1", "b2")).alias("bucket"), target).where("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    counts = written(counts, "quality-counts")
    totals = counts.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target")).first()
    n_raw, n_target = (totals["n_raw"] or 0), (totals["n_target"] or 0)
    if not n_target:
        return counts.select("bucket", F.lit(0).cast("long").alias("llr"))
    p = (F.col("target") + PRIOR) / (n_target + PRIOR * BUCKETS)
    q = (F.col("raw") + PRIOR) / (n_raw + PRIOR * BUCKETS)
    return counts.select("bucket", F.round(F.log(p / q) * UNIT).cast("long").alias("llr"))


def score(worded: DataFrame, ratios: DataFrame, *keep: str) -> DataFrame:
    """Mean log ratio over a document's n-grams; 0 for texts without words."""
    small = F.broadcast(ratios)  # at most BUCKETS rows
    at = _positions(worded, *keep)
    at = at.join(small.select(F.col("bucket").alias("b1"), F.col("llr").alias("l1")), "b1", "left")
    at = at.join(small.select(F.col("bucket").alias("b2"), F.col("llr").alias("l2")), "b2", "left")
    n = F.count("b1") + F.count("b2")
    total = F.sum(F.coalesce("l1", F.lit(0).cast("long")) + F.coalesce("l2", F.lit(0).cast("long")))
    return at.groupBy(*keep).agg(F.when(n == 0, 0.0).otherwise(total / (n * F.lit(float(UNIT)))).alias("llr"))


def threshold(scored: DataFrame) -> float:
    """Middle between the trusted and the rejected documents' median scores, but never above the
    score that TRUSTED_TAIL of the trusted ones miss.  Without either label nothing is cut."""
    fit = scored.where("not base_failed and fit_label is not null").select("fit_label", "llr")
    at = {(r["fit_label"], r["q"]): r["value"] for r in exact_quantiles(fit, ["fit_label"], "llr", [TRUSTED_TAIL, 0.5]).collect()}
    if (1, 0.5) not in at or (0, 0.5) not in at:
        return float("-inf")
    return min(at[1, TRUSTED_TAIL], (at[1, 0.5] + at[0, 0.5]) / 2)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    One row for each row of ``docs``; null text counts as empty, empty tables give empty
    results, repeated rows repeat, other columns of ``docs`` are ignored.  A null doc_id is
    scored but never serves as a fit row.  ``kept`` is false for base failures and for scores
    below the threshold.
    """
    docs, labels = docs.select("doc_id", "text"), _fit_rows(labels)
    # labels have no bound, so texts meet them in a shuffle: once, for the ratios; scores meet them without their texts
    ratios = ratio_table(docs.join(labels.hint("merge"), "doc_id", "left").withColumn("words", words_of(text_of())))
    keep = ["doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    ruled = rule_columns(docs.withColumn("row", F.monotonically_increasing_id()))
    scored = written(score(ruled, ratios, *keep), "quality-scores").drop("row")
    fit = scored.select("doc_id", "base_failed", "llr").join(labels.hint("merge"), "doc_id")
    cut = threshold(written(fit.drop("doc_id"), "quality-fit"))
    kept = ~F.col("base_failed") & (F.col("llr") >= F.lit(cut))
    return scored.withColumn("kept", kept)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
