"""Statistics that respect time dependence and many trials, as grouped aggregates.

Resampling draws come from keyed hashes, so they are the same however the rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import or_
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import prefix_scan, uniform
from ..sources.tables import written


def cluster_se(df: DataFrame, by: list[str], value: str, cluster: str) -> DataFrame:
    """n, clusters, mean, se (infinite becomes null below two clusters) of each group, by cluster sums."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    m = c.groupBy(*by).agg(F.sum("__s").alias("__total"), F.sum("__n").alias("n"))
    j = c.join(m, by).withColumn("mean", F.col("__total") / F.col("n"))
    g = j.groupBy(*by, "n", "mean").agg(F.count("*").alias("clusters"), F.sum(F.pow(F.col("__s") - F.col("__n") * F.col("mean"), 2)).alias("__d"))
    se = F.when(F.col("clusters") > 1, F.sqrt(F.col("__d") * F.col("clusters") / (F.col("clusters") - 1)) / F.col("n"))
    return g.select(*by, "n", "clusters", "mean", se.alias("se"))


#: Summaries hold this many values; a quantile is looked for among the 1/``MARGIN`` of the values on both sides of its approximation.
SUMMARY, MARGIN = 4096, 256
#: Ranges of values in which ranks are counted.
RANGES = 64


def exact_quantiles(df: DataFrame, by: list[str], column: str, qs: Sequence[float]) -> DataFrame:
    """``by``, q, value: exact quantiles of ``column``, interpolated between neighbours; rows without a value don't count.

    Approximate quantiles a little below and above each of ``qs`` bound where it lies.  Values below the bounds are only numbered,
    those between them are counted by value and scanned; the neighbours are the least of them whose running count
    passes the rank.  A rank outside its bounds, which the summaries rule out, is an error.  Groups are few: their bounds are broadcast.
    """
    if not by:
        return exact_quantiles(df.withColumn("__all", F.lit(1)), ["__all"], column, qs).drop("__all")
    held = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(*by, F.col(column).cast("double").alias("__x"))
    ends = [x for q in qs for x in (max(0.0, q - 1 / MARGIN), min(1.0, q + 1 / MARGIN))]
    at = held.groupBy(*by).agg(F.percentile_approx("__x", ends, SUMMARY).alias("__at"), F.count("*").alias("__n"))
    # at a small number of values the ranks next to a quantile may lie beyond: all of them are looked at
    closed = lambda i, e: F.when((F.col("__n") > 4 * MARGIN) & F.lit(0 < e < 1), F.col("__at")[i])
    bounds = written(at.select(*by, "__n", *[F.coalesce(closed(i, e), F.lit(float("inf" if i % 2 else "-inf"))).alias(f"__e{i}") for i, e in enumerate(ends)]))
    met = held.join(F.broadcast(bounds), by)
    spans = [(q, F.col(f"__e{2 * k}"), F.col(f"__e{2 * k + 1}")) for k, q in enumerate(qs)]
    counted = met.groupBy(*by).agg(*[F.count(F.when(F.col("__x") < lo, 1)).alias(f"__u{k}") for k, (_, lo, _) in enumerate(spans)])
    under = counted.select(*by, F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"__u{k}").alias("__under")) for k, q in enumerate(qs)])).alias("__s")).select(*by, "__s.*")
    held_by = [(q, F.col("__x").between(lo, hi)) for q, lo, hi in spans]
    near = met.where(reduce(or_, [c for _, c in held_by])).select(*by, "__n", "__x", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(q)) for q, c in held_by]))).alias("q"))
    keys = [*by, "__n", "q"]
    counts = written(near.groupBy(*keys, "__x").agg(F.count("*").alias("__k")))
    width = counts.groupBy(*keys).agg(F.min("__x").alias("__least"), F.max("__x").alias("__most"))
    inside = counts.join(F.broadcast(width.join(under, [*by, "q"])), keys)
    part = F.floor(RANGES * (F.col("__x") - F.col("__least")) / F.greatest(F.col("__most") - F.col("__least"), F.lit(1e-300)))
    ranked = prefix_scan(inside, keys, ["__x"], part, {"__upto": ("sum", F.col("__k"))}).withColumn("__upto", F.col("__upto") + F.col("__under"))
    rank = (F.col("__n") - 1) * F.col("q")
    found = ranked.groupBy(*keys).agg(F.min("__under").alias("__under"), *(F.min(F.when(F.col("__upto") > f(rank), F.col("__x"))).alias(c) for c, f in (("__lo", F.floor), ("__hi", F.ceil))))
    value = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (rank - F.floor(rank))
    sure = (F.col("__under") <= F.floor(rank)) & F.col("__hi").isNotNull()
    return found.select(*by, "q", F.when(sure, value).otherwise(F.raise_error(F.lit("a quantile lies outside its bounds")).cast("double")).alias("value"))


def cluster_bootstrap(df: DataFrame, by: list[str], value: str, cluster: str, reps: int, conf: float, seed: str) -> DataFrame:
    """Percentile interval of the mean from whole clusters drawn with replacement: lo, hi."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    c = c.withColumn("__i", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("__g", F.count("*").over(w))
    draws = c.select(*by, F.col("__i").alias("__k"), "__g", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    draws = draws.withColumn("__i", F.floor(uniform(seed, *[F.col(b) for b in by], F.col("rep"), F.col("__k")) * F.col("__g")).cast("int"))
    picked = draws.join(c.select(*by, "__i", "__s", "__n"), [*by, "__i"])
    means = picked.groupBy(*by, "rep").agg((F.sum("__s") / F.sum("__n")).alias("__m"))
    return means.groupBy(*by).agg(F.percentile("__m", F.lit((1 - conf) / 2)).alias("lo"), F.percentile("__m", F.lit((1 + conf) / 2)).alias("hi"))


def stationary_paths(length: int, mean_block: float, reps: int, seed: str, spark) -> DataFrame:
    """rep, t, idx: index paths that restart with probability 1/mean_block and else go on, modulo ``length``."""
    t = spark.range(length).select(F.col("id").cast("int").alias("t"))
    p = t.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    restart = (F.col("t") == 0) | (uniform(seed, F.col("rep"), F.col("t"), "r") < 1 / mean_block)
    start = F.when(restart, F.struct(F.floor(uniform(seed, F.col("rep"), F.col("t"), "i") * length).cast("int").alias("i"), F.col("t").alias("t")))
    w = Window.partitionBy("rep").orderBy("t")
    last = F.last(start, True).over(w)
    return p.withColumn("__l", last).select("rep", "t", ((F.col("__l.i") + F.col("t") - F.col("__l.t")) % length).alias("idx"))


def expected_shortfall(df: DataFrame, by: list[str], value: str, alpha: float, width: float = 2.0**-10) -> DataFrame:
    """Mean of the worst max(1, ceil(alpha n)) values: distinct values are counted and scanned in buckets of ``width``, so no
    task sees all rows of a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    total = counts.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.sum("__n") * alpha)).alias("__k"))
    scanned = prefix_scan(counts, by, [value], F.floor(F.col(value) / width), {"__before": ("sum<", F.col("__n"))}).join(total, by)
    taken = F.greatest(F.lit(0), F.least(F.col("__n"), F.col("__k") - F.col("__before")))
    return scanned.where("__before < __k").groupBy(*by).agg((F.sum(F.col(value) * taken) / F.max("__k")).alias("es"))


def drawdown(df: DataFrame, by: list[str], order: str, value: str, initial: float) -> DataFrame:
    """Final equity and largest fall from a peak, absolute and as a fraction, of cumulated values."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("__e", initial + F.sum(value).over(w)).withColumn("__p", F.greatest(F.lit(initial), F.max("__e").over(w)))
    # Spark can't nest windows: the equity is a column before its maximum is taken
    return e.groupBy(*by).agg(F.max_by("__e", order).alias("final"), F.max(F.col("__p") - F.col("__e")).alias("dd_abs"), F.max(F.when(F.col("__p") > 0, (F.col("__p") - F.col("__e")) / F.col("__p"))).alias("dd_frac"))


def profit_factor(value: str) -> Column:
    """Gains over losses; infinite without losses, null with neither."""
    gains, losses = F.sum(F.greatest(F.col(value), F.lit(0.0))), F.sum(F.greatest(-F.col(value), F.lit(0.0)))
    return F.when(losses > 0, gains / losses).when(gains > 0, F.lit(float("inf")))


def deflated_sharpe(n: int, sharpe: float, skew: float, kurtosis: float, trials: int, variance: float) -> float | None:
    """Probability that a Sharpe ratio beats the best of ``trials`` without skill; kurtosis is 3 for a normal series."""
    if n < 10:
        return None
    normal, euler = NormalDist(), 0.5772156649015329
    best = math.sqrt(variance) * ((1 - euler) * normal.inv_cdf(1 - 1 / trials) + euler * normal.inv_cdf(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    return normal.cdf((sharpe - best) * math.sqrt(n - 1) / math.sqrt(max(spread, 1e-12)))


def pbo(perf: DataFrame, period: str, model: str, value: str, groups: int = 8) -> DataFrame:
    """combo, best, rank share of the in-sample best model out of sample, over all half-splits of contiguous groups.

    The share of combos whose ``logit`` is not above 0 is the probability of overfitting.
    """
    spark = perf.sparkSession
    splits = list(combinations(range(1, groups + 1), groups // 2))
    member = spark.createDataFrame([(i, g, g in set(c)) for i, c in enumerate(splits) for g in range(1, groups + 1)], "combo int, g int, inside boolean")
    periods = perf.select(period).distinct().withColumn("g", F.ntile(groups).over(Window.orderBy(period)))
    sums = perf.join(periods, period).groupBy("g", model).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    halves = sums.join(F.broadcast(member), "g").groupBy("combo", "inside", model).agg((F.sum("__s") / F.sum("__n")).alias("m"))
    w = Window.partitionBy("combo")
    best = halves.where("inside").withColumn("__r", F.row_number().over(w.orderBy(F.desc("m"), model))).where("__r = 1").select("combo", F.col(model).alias("best"))
    out = halves.where("not inside").withColumn("rank", F.rank().over(w.orderBy("m")) + (F.count("*").over(Window.partitionBy("combo", "m")) - 1) / 2).withColumn("k", F.count("*").over(w))
    share = F.col("rank") / (F.col("k") + 1)
    return out.join(best, (out["combo"] == best["combo"]) & (out[model] == best["best"])).select(out["combo"], "best", share.alias("share"), F.log(share / (1 - share)).alias("logit"))


#: Values of each part that a drift needs.
LEAST_PSI = 100


def psi(expected: DataFrame, actual: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """feature, psi: shift of the distribution over quantile bins of the expected values; null where either part has fewer
    than ``LEAST_PSI`` values."""

    def long(df: DataFrame, part: str) -> DataFrame:
        pairs = F.expr("stack({}, {}) AS (feature, x)".format(len(features), ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)))
        return df.select(pairs).where("x is not null").withColumn("part", F.lit(part))

    edges = long(expected, "e").groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile("x", F.array(*[F.lit(i / bins) for i in range(bins + 1)])))).alias("edges"))
    both = long(expected, "e").unionByName(long(actual, "a")).join(edges, "feature")
    last = F.size("edges") - 1
    at = F.greatest(F.lit(1), F.least(last, F.size(F.filter("edges", lambda e: e <= F.col("x")))))
    counts = both.groupBy("feature", at.alias("bin"), last.alias("bins")).agg(F.count(F.when(F.col("part") == "e", 1)).alias("e"), F.count(F.when(F.col("part") == "a", 1)).alias("a"))
    w = Window.partitionBy("feature")
    p, q = F.col("e") / F.sum("e").over(w) + 1e-6, F.col("a") / F.sum("a").over(w) + 1e-6
    enough = (F.sum("e") >= LEAST_PSI) & (F.sum("a") >= LEAST_PSI)
    return counts.withColumn("__t", (q - p) * F.log(q / p)).groupBy("feature").agg(F.when(enough, F.sum("__t")).alias("psi"))
