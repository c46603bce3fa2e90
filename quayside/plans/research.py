"""Queries over feature screens, models, policies, trades, statistics, risk and governance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scans import non_overlapping, prefix_scan, rolling
from ..operators import risk, schema, stats
from ..sources.tables import written
from ..sources.views import DAY, LEVELS, QUOTES, TAPE, levels, quotes, table, tape

FEATURES = [f"f{i}" for i in range(64)]
R = lambda c, n=6: F.round(c, n)
MONTH_NS = 30 * DAY
#: Ids of one bucket of a scan along the matrix.
IDS = 1 << 16


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, target, f0..f63 of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("target"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)])


MATRIX = "mx AS (SELECT vec_id, CAST(label AS DOUBLE) AS target, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(len(FEATURES))) + " FROM embeddings)"
_LONG = f"{MATRIX}, lg AS (SELECT vec_id, target, feature, x FROM mx UNPIVOT (x FOR feature IN ({', '.join(FEATURES)})))"


def unpivoted(m: DataFrame, *keep: str) -> DataFrame:
    stack = "stack({}, {}) AS (feature, x)".format(len(FEATURES), ", ".join(f"'{f}', {f}" for f in FEATURES))
    return m.select(*keep, F.expr(stack))


def long_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpivoted(matrix(spark, sf_dir), "vec_id", "target")


def placed(m: DataFrame) -> DataFrame:
    """``m`` with its rows' ``place`` by vec_id from 0, and their number ``rows``: a scan over ranges of ids, no task sees all."""
    n = m.agg(F.count("*").alias("rows"))  # one row
    scanned = prefix_scan(m.withColumn("__one", F.lit(1)), ["__one"], ["vec_id"], F.floor(F.col("vec_id") / IDS), {"place": ("count", F.lit(1))})
    return scanned.drop("__one").withColumn("place", F.col("place") - 1).join(F.broadcast(n))


def tile(place: Column, rows: Column, k: int) -> Column:
    """The block from 1 of a place among k contiguous ones that are as equal as can be, larger ones first."""
    size, more = F.floor(rows / k), rows % k
    return F.when(place < more * (size + 1), F.floor(place / (size + 1))).otherwise(more + F.floor((place - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1


def average_rank(df: DataFrame, keys: list[str], x: str, out: str, width: float = 2.0**-8) -> DataFrame:
    """``df`` with the rank of ``x`` inside ``keys``, ties sharing their mean (W08): distinct values are counted and scanned in
    buckets of ``width``, so no task sees all rows of a key.  Rows without ``x`` go."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("__n"))
    ranks = prefix_scan(counts, keys, [x], F.floor(F.col(x) / width), {"__upto": ("sum", F.col("__n"))})
    return df.join(ranks.select(*keys, x, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out)), [*keys, x])


def gram(df: DataFrame, columns: list[str], digits: int | None = None) -> DataFrame:
    """a, b, s: sums of products of each two ``columns`` (a before b in their order, or the same); tasks multiply Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(columns), len(columns)))
        for batch in batches:
            x = batch.to_numpy(float)
            total += x.T @ x
        i, j = np.triu_indices(len(columns))
        yield pd.DataFrame({"a": np.array(columns, object)[i], "b": np.array(columns, object)[j], "s": total[i, j]})

    sums = df.select(*columns).mapInPandas(run, "a string, b string, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))
    return sums if digits is None else sums.withColumn("s", F.round("s", digits))


def feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing share and constancy of each feature."""
    return long_matrix(spark, sf_dir).groupBy("feature").agg(R(F.avg(F.col("x").isNull().cast("int"))).alias("missing"), R(F.stddev_pop("x")).alias("sd"), (F.stddev_pop("x") > 1e-12).alias("kept"))


def _block_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = placed(matrix(spark, sf_dir)).withColumn("block", tile(F.col("place"), F.col("rows"), 8))
    m = written(unpivoted(m, "vec_id", "target", "block"))
    y = average_rank(m.where("feature = 'f0'").select("vec_id", "block", "target"), ["block"], "target", "ry").select("vec_id", "block", "ry")  # the same for all features
    x = average_rank(m.select("vec_id", "block", "feature", "x"), ["feature", "block"], "x", "rx")
    return x.join(y, ["vec_id", "block"]).groupBy("feature", "block").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("ic"))


def block_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation with the target in eight blocks of rows."""
    return _block_ic(spark, sf_dir).select("feature", "block", "n", R("ic").alias("ic"))


IC = f"""{_LONG}, b AS (SELECT *, ntile(8) OVER (PARTITION BY feature ORDER BY vec_id) AS block FROM lg),
 r AS (SELECT *, rank() OVER (PARTITION BY feature, block ORDER BY x) + (count(*) OVER (PARTITION BY feature, block, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature, block ORDER BY target) + (count(*) OVER (PARTITION BY feature, block, target) - 1) / 2 AS ry FROM b),
 ic AS (SELECT feature, block, count(*) AS n, corr(rx, ry) AS ic FROM r GROUP BY feature, block)"""


def ic_tstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t statistic of the blocks' correlations."""
    return _block_ic(spark, sf_dir).groupBy("feature").agg(F.count("ic").alias("blocks"), R(F.avg("ic") / (F.stddev_samp("ic") / F.sqrt(F.count("ic")))).alias("t"))


def _rank_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, corr: rank correlation of each two features."""
    ranks = average_rank(long_matrix(spark, sf_dir).select("vec_id", "feature", "x"), ["feature"], "x", "r")
    n = ranks.groupBy("feature").agg(F.count("*").alias("n"))  # one row a feature
    ranks = ranks.join(F.broadcast(n), "feature").withColumn("r", F.col("r") - (F.col("n") + 1) / 2)
    wide = ranks.groupBy("vec_id").agg(*[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("r"))), F.lit(0.0)).alias(f) for f in FEATURES])
    s = gram(wide, FEATURES)
    own = s.where("a = b").select(F.col("a").alias("f"), "s")  # one row a feature
    pairs = s.where("a <> b").join(F.broadcast(own.withColumnsRenamed({"f": "a", "s": "sa"})), "a").join(F.broadcast(own.withColumnsRenamed({"f": "b", "s": "sb"})), "b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("s") / F.sqrt(F.col("sa") * F.col("sb"))).alias("corr"))


def rank_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of each pair of features."""
    return _rank_corr(spark, sf_dir).select("a", "b", R("corr").alias("corr"))


REDUNDANT = 0.1


def feature_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in order of their absolute t, each dropped whose rank correlation with one kept before reaches a limit.

    The greedy pass runs over a table of features times features, whatever the number of rows."""
    t = {r["feature"]: r["t"] for r in ic_tstat(spark, sf_dir).collect()}
    corr = {(r["a"], r["b"]): r["corr"] for r in rank_corr_matrix(spark, sf_dir).collect()}
    kept: list[str] = []
    out = []
    for f in sorted(t, key=lambda f: (-abs(t[f] or 0.0), f)):
        over = next((k for k in kept if abs(corr[min(f, k), max(f, k)]) >= REDUNDANT), None)
        if over is None:
            kept.append(f)
        out.append((f, t[f], over is None, over))
    return spark.createDataFrame(out, "feature string, t double, kept boolean, redundant_with string")


def standardised(m: DataFrame) -> DataFrame:
    """Features less their mean over their deviation, missing ones replaced by the median before, clipped at 8."""
    q = stats.exact_quantiles(unpivoted(m), ["feature"], "x", [0.5])
    medians = q.agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"q_{f}") for f in FEATURES])  # one row
    m = m.join(F.broadcast(medians)).select("vec_id", "target", *[F.coalesce(f, f"q_{f}").alias(f) for f in FEATURES])
    moments = m.agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES])
    return m.join(F.broadcast(moments)).select("vec_id", "target", *[F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}"))).alias(f) for f in FEATURES])


def ridge_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sufficient statistics of standardised features for every ridge penalty."""
    s = gram(standardised(matrix(spark, sf_dir)), [*FEATURES, "target"], 4).where("a <> 'target'")
    least, most = F.least("a", "b"), F.greatest("a", "b")
    return s.select(F.when(F.col("b") == "target", F.col("a")).otherwise(least).alias("a"), F.when(F.col("b") == "target", F.col("b")).otherwise(most).alias("b"), "s")


GRAM = f"WITH {MATRIX}, mm AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES) + " FROM mx), z AS (SELECT vec_id, target, " + ", ".join(f"greatest(-8, least(8, ({f} - m_{f}) / s_{f})) AS {f}" for f in FEATURES) + " FROM mx, mm), " \
    f"l AS (SELECT vec_id, target, feature, x FROM z UNPIVOT (x FOR feature IN ({', '.join(FEATURES)}))) SELECT p.feature AS a, q.feature AS b, round(sum(p.x * q.x), 4) AS s FROM l p JOIN l q ON p.vec_id = q.vec_id AND p.feature <= q.feature GROUP BY 1, 2 UNION ALL SELECT feature, 'target', round(sum(x * target), 4) FROM l GROUP BY 1"


PENALTIES = (0.1, 1.0, 10.0, 100.0, 1000.0)


def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge coefficients with the penalty that has the least squared error on the last quarter of rows, refitted on all.

    One pass sums products for the first three quarters and the last one apart; features, not rows, reach
    the driver, and the validation error of every penalty follows from the last quarter's sums.
    """
    names = [*FEATURES, "target", "one"]
    z = written(placed(standardised(matrix(spark, sf_dir))).withColumn("one", F.lit(1.0)))
    late = tile(F.col("place"), F.col("rows"), 4) == 4
    grams = []
    for part in (~late, late):
        g = np.zeros((len(names), len(names)))
        for r in gram(z.where(part), names).collect():  # features squared
            i, j = names.index(r["a"]), names.index(r["b"])
            g[i, j] = g[j, i] = r["s"]
        grams.append(g)
    p = len(FEATURES)

    def solve(g: np.ndarray, penalty: float) -> np.ndarray:
        """Coefficients and intercept; the intercept isn't penalised."""
        n = max(1.0, g[-1, -1])
        mean, ty = g[:p, -1] / n, g[-2, -1] / n
        c = np.linalg.solve(g[:p, :p] - n * np.outer(mean, mean) + penalty * np.eye(p), g[:p, p] - n * mean * ty)
        return np.append(c, ty - mean @ c)

    def error(g: np.ndarray, w: np.ndarray) -> float:
        at = [*range(p), p + 1]
        return float(g[p, p] - 2 * w @ g[at, p] + w @ g[np.ix_(at, at)] @ w)

    fit, val = grams
    enough = fit[-1, -1] > 100 and val[-1, -1] > 100
    penalty = min(PENALTIES, key=lambda k: error(val, solve(fit, k))) if enough else PENALTIES[-1]
    w = solve(fit + val, penalty)
    return spark.createDataFrame([(penalty, f, float(c)) for f, c in zip([*FEATURES, "intercept"], w, strict=True)], "penalty double, feature string, coefficient double")


#: Absolute t from which a feature counts as flow.
TOLD = 2.0


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, f0, flow: the sum of z scores signed by their t over the root of their number, of features whose t tells something."""
    t = {r["feature"]: r["t"] for r in ic_tstat(spark, sf_dir).where(F.abs("t") >= TOLD).collect()}  # one row a feature
    m, use = matrix(spark, sf_dir), sorted(t)
    if not use:
        return m.select("vec_id", "f0", F.lit(None).cast("double").alias("flow"))
    moments = m.agg(*[F.avg(f).alias(f"m_{f}") for f in use], *[F.stddev_pop(f).alias(f"s_{f}") for f in use])
    z = sum((F.coalesce((F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}"), F.lit(0.0)) * (1 if t[f] > 0 else -1) for f in use), F.lit(0.0))
    return m.join(F.broadcast(moments)).select("vec_id", "f0", (z / F.sqrt(F.lit(float(len(use))))).alias("flow"))


def flow_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed sum of the features that tell something."""
    return _flow(spark, sf_dir).select("vec_id", R("flow").alias("score"))


def lag_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag score where the flow agrees with it in sign."""
    return _flow(spark, sf_dir).select("vec_id", R(F.when(F.signum("f0") == F.signum("flow"), F.col("f0"))).alias("score"))


_FLOW = f"""{IC}, tt AS (SELECT feature, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t FROM ic GROUP BY feature HAVING abs(round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6)) >= {TOLD}),
 zz AS (SELECT vec_id, feature, (x - avg(x) OVER (PARTITION BY feature)) / stddev_pop(x) OVER (PARTITION BY feature) AS z FROM lg), fl AS (SELECT mx.vec_id, any_value(f0) AS f0, sum(sign(t) * coalesce(z, 0)) / sqrt(count(t)) AS flow FROM mx LEFT JOIN (zz JOIN tt USING (feature)) USING (vec_id) GROUP BY mx.vec_id)"""
FLOW = f"WITH {_FLOW} SELECT vec_id, round(flow, 6) AS score FROM fl"
LAG_FLOW = f"WITH {_FLOW} SELECT vec_id, round(CASE WHEN sign(f0) = sign(flow) THEN f0 END, 6) AS score FROM fl"


def gated_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of regimes: reversion where a feature exceeds its 80 % quantile, momentum where another exceeds its 67 %."""
    m = matrix(spark, sf_dir)
    at = lambda f, q: stats.exact_quantiles(m, [], f, [q]).select(F.col("value"))
    q = at("f1", 0.8).withColumnRenamed("value", "a").join(at("f4", 0.67).withColumnRenamed("value", "b"))  # one row
    return m.join(F.broadcast(q)).select("vec_id", R(F.when(F.col("f1") > F.col("a"), -F.col("f2"))).alias("shock_reversion"), R(F.when(F.col("f4") > F.col("b"), F.col("f3"))).alias("vol_momentum"))


GATED = f"WITH {MATRIX}, q AS (SELECT quantile_cont(f1, 0.8) AS a, quantile_cont(f4, 0.67) AS b FROM mx) SELECT vec_id, round(CASE WHEN f1 > a THEN -f2 END, 6) AS shock_reversion, round(CASE WHEN f4 > b THEN f3 END, 6) AS vol_momentum FROM mx, q"


def regime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terciles, median split and strong trend of three features."""
    m = matrix(spark, sf_dir)
    q = m.agg(F.percentile("f0", F.lit(1 / 3)).alias("a"), F.percentile("f0", F.lit(2 / 3)).alias("b"), F.percentile("f1", F.lit(0.5)).alias("c"), F.percentile(F.abs("f2"), F.lit(0.8)).alias("d"))
    c = F.col
    return m.join(F.broadcast(q)).select(
        "vec_id", F.when(c("f0").isNull(), "unknown").when(c("f0") <= c("a"), "low").when(c("f0") <= c("b"), "mid").otherwise("high").alias("vol"),
        F.when(c("f1").isNull(), "unknown").when(c("f1") <= c("c"), "tight").otherwise("wide").alias("spread"), F.when(c("f2").isNull(), "unknown").when(F.abs("f2") >= c("d"), "trend").otherwise("flat").alias("trend"))


REGIMES = f"""WITH {MATRIX}, q AS (SELECT quantile_cont(f0, CAST(1 AS DOUBLE) / 3) AS a, quantile_cont(f0, CAST(2 AS DOUBLE) / 3) AS b, quantile_cont(f1, 0.5) AS c, quantile_cont(abs(f2), 0.8) AS d FROM mx)
 SELECT vec_id, CASE WHEN f0 <= a THEN 'low' WHEN f0 <= b THEN 'mid' ELSE 'high' END AS vol, CASE WHEN f1 <= c THEN 'tight' ELSE 'wide' END AS spread, CASE WHEN abs(f2) >= d THEN 'trend' ELSE 'flat' END AS trend FROM mx, q"""


def isotonic_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone map from a score to the target."""
    from pyspark.ml.regression import IsotonicRegression

    m = matrix(spark, sf_dir).select("vec_id", F.col("f0").alias("features"), F.col("target").alias("label"))
    return IsotonicRegression().fit(m).transform(m).select("vec_id", "prediction")


TREES = 200


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the features."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    m = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(matrix(spark, sf_dir))
    least = max(20, m.count() // 200)
    return GBTRegressor(labelCol="target", stepSize=0.05, maxIter=TREES, maxDepth=4, minInstancesPerNode=least, seed=1).fit(m).transform(m).select("vec_id", "prediction")


def walk_forward(t0: int, t1: int, n: int, test: int, train: int, cal: float, gap: int) -> list[tuple]:
    """(fold, fit_start, fit_end, cal_start, cal_end, test_start, test_end): expanding fits before disjoint tests that end at ``t1``."""
    while n > 0 and train + 2 * gap + n * test > t1 - t0:  # a gap before the calibration and one before the test
        n -= 1
    if n <= 0:
        raise ValueError("too little data for a fold")
    out = []
    for k in range(n):
        start = t1 - (n - k) * test
        cal_end = start - gap
        cal_start = cal_end - int((cal_end - t0) * cal)
        out.append((k, t0, cal_start - gap, cal_start, cal_end, start, start + test))
    return out


def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tape in each part of five purged folds."""
    t = tape(spark, sf_dir)
    lo, hi = t.agg(F.min("ts_local_ns"), F.max("ts_local_ns")).first()
    folds = spark.createDataFrame(walk_forward(lo, hi, 5, 6 * MONTH_NS, 12 * MONTH_NS, 0.25, MONTH_NS), "fold int, fs long, fe long, cs long, ce long, ts long, te long")
    x = F.col("ts_local_ns")
    part = F.when((x >= F.col("fs")) & (x < F.col("fe")), "fit").when((x >= F.col("cs")) & (x < F.col("ce")), "cal").when((x >= F.col("ts")) & (x < F.col("te")), "test")
    return t.join(F.broadcast(folds)).withColumn("part", part).where("part is not null").groupBy("fold", "part").agg(F.count("*").alias("n"), R(F.avg("ret"), 8).alias("mean"))


FOLDS = f"""WITH {TAPE}, s AS (SELECT min(ts_local_ns) AS t0, max(ts_local_ns) AS t1 FROM tape), k AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold),
 f AS (SELECT fold, t0, t1 - (5 - fold) * 6 * {MONTH_NS} AS ts, t1 - (5 - fold) * 6 * {MONTH_NS} - {MONTH_NS} AS ce FROM s, k), g AS (SELECT *, ce - CAST(trunc((ce - t0) * CAST(0.25 AS DOUBLE)) AS BIGINT) AS cs FROM f),
 p AS (SELECT fold, ret, CASE WHEN x >= t0 AND x < cs - {MONTH_NS} THEN 'fit' WHEN x >= cs AND x < ce THEN 'cal' WHEN x >= ts AND x < ts + 6 * {MONTH_NS} THEN 'test' END AS part FROM (SELECT g.*, ret, ts_local_ns AS x FROM tape, g))
 SELECT fold, part, count(*) AS n, round(avg(ret), 8) AS mean FROM p WHERE part IS NOT NULL GROUP BY fold, part"""


#: Embargo, horizons and wait of the labels in seconds.
EMBARGO, HORIZONS, WAIT = 3600.0, (3600.0, 7200.0), 43_200.0


def purged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three folds over the quotes' span, apart by the gap that the measured latencies ask for."""
    q = quotes(spark, sf_dir)
    lo, hi = q.agg(F.min("ts_local_ns"), F.max("ts_local_ns")).first()
    p99 = stats.exact_quantiles(q.select(((F.col("ts_local_ns") - F.col("ts_exch_ns")) / 1e6).alias("d")).where("d > 0"), [], "d", [0.99]).first()["value"]
    gap = schema.purge_gap_ns(EMBARGO, HORIZONS, p99, WAIT)
    folds = walk_forward(lo, hi + 1, 3, 5 * DAY, 8 * DAY, 0.25, gap)
    return spark.createDataFrame([(*f, gap) for f in folds], "fold int, fit_start long, fit_end long, cal_start long, cal_end long, test_start long, test_end long, gap_ns long")


PURGED = f"""WITH {QUOTES}, p AS (SELECT quantile_cont((ts_local_ns - ts_exch_ns) / 1e6, 0.99) AS p99 FROM quotes WHERE ts_local_ns > ts_exch_ns), s AS (SELECT min(ts_local_ns) AS t0, max(ts_local_ns) + 1 AS t1 FROM quotes),
 g AS (SELECT CAST(trunc(greatest(CAST({EMBARGO} AS DOUBLE), CAST({max(HORIZONS)} AS DOUBLE) + 2 * p99 / CAST(1000 AS DOUBLE) + CAST({WAIT} AS DOUBLE) + 10) * 1e9) AS BIGINT) AS gap FROM p),
 f AS (SELECT CAST(fold AS INTEGER) AS fold, t0, t1 - (3 - fold) * 5 * {DAY} AS ts, t1 - (3 - fold) * 5 * {DAY} - gap AS ce, gap FROM s, g, (SELECT unnest(range(3)) AS fold)), c AS (SELECT *, ce - CAST(trunc((ce - t0) * CAST(0.25 AS DOUBLE)) AS BIGINT) AS cs FROM f)
 SELECT fold, t0 AS fit_start, cs - gap AS fit_end, cs AS cal_start, ce AS cal_end, ts AS test_start, ts + 5 * {DAY} AS test_end, gap AS gap_ns FROM c"""


def beyond_thresholds(tape: DataFrame) -> DataFrame:
    """Trades, mean, cluster error and lower bound of ``tape`` beyond eight score quantiles of each mode."""
    t = tape.withColumn("score", F.col("price")).withColumn("block", F.floor(F.col("ts_local_ns") / MONTH_NS))
    qs = [i / 10 for i in range(1, 9)]  # 0.1 * 3 is more than 0.3 and would pass the rank of a whole number
    place = F.create_map(*[F.lit(x) for k, q in enumerate(qs) for x in (q, k)])
    th = stats.exact_quantiles(t, ["mode"], "score", qs).select("mode", place[F.col("q")].alias("k"), F.col("value").alias("threshold"))
    hit = t.join(F.broadcast(th), "mode").where("score >= threshold")
    out = stats.cluster_se(hit, ["mode", "k"], "ret", "block")
    return out.select("mode", "k", "n", "clusters", R("mean", 8).alias("mean"), R("se", 8).alias("se"), R(F.col("mean") - 1.645 * F.col("se"), 8).alias("lcb"))


def threshold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beyond_thresholds(tape(spark, sf_dir))


THRESHOLDS = f"""WITH {TAPE}, q AS (SELECT mode, quantile_cont(price, [{', '.join(f'{0.1 * i:.1f}' for i in range(1, 9))}]) AS th FROM tape GROUP BY mode), u AS (SELECT mode, CAST(k AS INTEGER) AS k, th[k + 1] AS threshold FROM q, (SELECT unnest(range(8)) AS k)),
 h AS (SELECT t.mode, k, ts_local_ns // {MONTH_NS} AS block, sum(ret) AS s, count(*) AS n FROM tape t JOIN u ON t.mode = u.mode AND price >= threshold GROUP BY ALL), m AS (SELECT *, sum(s) OVER (PARTITION BY mode, k) / sum(n) OVER (PARTITION BY mode, k) AS mean FROM h),
 z AS (SELECT mode, k, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, any_value(mean) AS mean, sqrt(sum(pow(s - n * mean, 2)) * count(*) / (count(*) - 1)) / sum(n) AS se FROM m GROUP BY mode, k)
 SELECT mode, k, n, clusters, round(mean, 8) AS mean, round(se, 8) AS se, round(mean - CAST(1.645 AS DOUBLE) * se, 8) AS lcb FROM z"""


def decide_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side whose score passes and whose calibrated mean is larger, long first."""
    q = quotes(spark, sf_dir)
    mu_l, mu_s = F.col("bid_sz") - 4, F.col("ask_sz") - 6
    long_ok, short_ok = F.col("bid_sz") >= 4, F.col("ask_sz") >= 7
    side = F.when(short_ok & (~long_ok | (mu_s > mu_l)), -1).when(long_ok, 1).otherwise(0)
    return q.select("event_id", side.alias("side"), F.when(side == 1, mu_l).when(side == -1, mu_s).alias("mu"))


DECIDE = f"""WITH {QUOTES}, s AS (SELECT *, CASE WHEN ask_sz >= 7 AND (bid_sz < 4 OR ask_sz - 6 > bid_sz - 4) THEN -1 WHEN bid_sz >= 4 THEN 1 ELSE 0 END AS side FROM quotes)
 SELECT event_id, side, CASE side WHEN 1 THEN bid_sz - 4 WHEN -1 THEN ask_sz - 6 END AS mu FROM s"""


def non_overlap_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that open a position: one at a time in each market."""
    s = levels(spark, sf_dir).select("symbol", "seq", F.col("ts_local_ns").alias("t_open")).withColumn("t_close", F.col("t_open") + (F.col("seq") % 7 + 1) * DAY)
    return non_overlapping(s, "symbol", "seq", "t_open", "t_close", written, MONTH_NS)


NON_OVERLAP = f"""WITH RECURSIVE {LEVELS}, s AS (SELECT symbol, seq, ts_local_ns AS a, ts_local_ns + (seq % 7 + 1) * {DAY} AS b FROM levels), u AS (SELECT symbol, a AS t, 1 AS side, seq, seq AS me FROM s UNION ALL SELECT symbol, b, 0, seq, NULL FROM s),
 n AS (SELECT symbol, seq, nxt FROM (SELECT symbol, seq, side, first_value(me IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t, side, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM u) WHERE side = 0),
 f AS (SELECT symbol, min_by(seq, a) AS seq FROM s GROUP BY symbol), r AS (SELECT symbol, seq FROM f UNION ALL SELECT n.symbol, n.nxt FROM r JOIN n ON r.symbol = n.symbol AND r.seq = n.seq WHERE n.nxt IS NOT NULL) SELECT symbol, seq FROM r"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape(spark, sf_dir).withColumn("block", F.floor(F.col("ts_local_ns") / MONTH_NS))


def period_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of returns by month, zero where nothing was traded."""
    b = _blocks(spark, sf_dir)
    span = b.agg(F.min("block").alias("lo"), F.max("block").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("block"))
    calendar = span.join(F.broadcast(b.select("model").distinct()))
    sums = b.groupBy("model", "block").agg(F.sum("ret").alias("v"))
    return calendar.join(sums, ["model", "block"], "left").select("model", "block", R(F.coalesce("v", F.lit(0.0)), 7).alias("value"))


_SERIES = f"""{TAPE}, b AS (SELECT model, ts_local_ns // {MONTH_NS} AS block, sum(ret) AS v FROM tape GROUP BY ALL), c AS (SELECT unnest(range((SELECT min(block) FROM b), (SELECT max(block) FROM b) + 1)) AS block),
 ps AS (SELECT m.model, c.block, coalesce(v, 0) AS value FROM c CROSS JOIN (SELECT DISTINCT model FROM b) m LEFT JOIN b ON b.model = m.model AND b.block = c.block)"""


def equity_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final equity and drawdowns of the monthly series."""
    d = stats.drawdown(period_series(spark, sf_dir), ["model"], "block", "value", 100.0)
    return d.select("model", R("final", 4).alias("final"), R("dd_abs", 4).alias("dd_abs"), R("dd_frac", 6).alias("dd_frac"))


DRAWDOWN = f"""WITH {_SERIES}, e AS (SELECT model, block, 100 + sum(round(value, 7)) OVER (PARTITION BY model ORDER BY block ROWS UNBOUNDED PRECEDING) AS e FROM ps), p AS (SELECT *, greatest(100, max(e) OVER (PARTITION BY model ORDER BY block ROWS UNBOUNDED PRECEDING)) AS p FROM e)
 SELECT model, round(max_by(e, block), 4) AS final, round(max(p - e), 4) AS dd_abs, round(max((p - e) / p), 6) AS dd_frac FROM p GROUP BY model"""


def expected_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.expected_shortfall(tape(spark, sf_dir), ["model", "mode"], "ret", 0.05).select("model", "mode", R("es", 8).alias("es"))


ES = f"""WITH {TAPE}, r AS (SELECT model, mode, ret, row_number() OVER (PARTITION BY model, mode ORDER BY ret) AS r, greatest(1, ceil(count(*) OVER (PARTITION BY model, mode) * CAST(0.05 AS DOUBLE))) AS k FROM tape) SELECT model, mode, round(avg(ret), 8) AS es FROM r WHERE r <= k GROUP BY ALL"""


def regime_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and cluster error by two regimes at once."""
    t = _blocks(spark, sf_dir).withColumn("size_regime", F.when(F.col("size") <= 25, "small").otherwise("large")).withColumn("side_regime", F.when(F.col("taker_side") > 0, "buy").otherwise("sell"))
    long = t.select("block", "ret", F.expr("stack(2, 'size', size_regime, 'side', side_regime) AS (regime, label)"))
    return stats.cluster_se(long, ["regime", "label"], "ret", "block").select("regime", "label", "n", "clusters", R("mean", 8).alias("mean"), R("se", 8).alias("se"))


BREAKDOWN = f"""WITH {TAPE}, l AS (SELECT ts_local_ns // {MONTH_NS} AS block, ret, 'size' AS regime, CASE WHEN size <= 25 THEN 'small' ELSE 'large' END AS label FROM tape UNION ALL SELECT ts_local_ns // {MONTH_NS}, ret, 'side', CASE WHEN taker_side > 0 THEN 'buy' ELSE 'sell' END FROM tape),
 h AS (SELECT regime, label, block, sum(ret) AS s, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT *, sum(s) OVER (PARTITION BY regime, label) / sum(n) OVER (PARTITION BY regime, label) AS mean FROM h)
 SELECT regime, label, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, round(any_value(mean), 8) AS mean, round(sqrt(sum(pow(s - n * mean, 2)) * count(*) / (count(*) - 1)) / sum(n), 8) AS se FROM m GROUP BY regime, label"""


def rejection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons that signals weren't taken, with counts."""
    taken = non_overlap_trades(spark, sf_dir).withColumn("taken", F.lit(True))
    s = levels(spark, sf_dir).join(taken, ["symbol", "seq"], "left")
    reason = F.when(F.col("taken") & (F.col("size") > 0), "executed").when(F.col("taken"), "execution_unavailable").otherwise("position_open")
    return s.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


REJECTIONS = NON_OVERLAP.rsplit("SELECT symbol, seq FROM r", 1)[0] + " SELECT CASE WHEN r.seq IS NOT NULL AND size > 0 THEN 'executed' WHEN r.seq IS NOT NULL THEN 'execution_unavailable' ELSE 'position_open' END AS reason, count(*) AS n FROM levels l LEFT JOIN r ON l.symbol = r.symbol AND l.seq = r.seq GROUP BY 1"


def cluster_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster-robust error of the mean by model."""
    return stats.cluster_se(_blocks(spark, sf_dir), ["model"], "ret", "block").select("model", "n", "clusters", R("mean", 8).alias("mean"), R("se", 8).alias("se"))


CLUSTER = f"""WITH {TAPE}, h AS (SELECT model, ts_local_ns // {MONTH_NS} AS block, sum(ret) AS s, count(*) AS n FROM tape GROUP BY ALL), m AS (SELECT *, sum(s) OVER (PARTITION BY model) / sum(n) OVER (PARTITION BY model) AS mean FROM h)
 SELECT model, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, round(any_value(mean), 8) AS mean, round(sqrt(sum(pow(s - n * mean, 2)) * count(*) / (count(*) - 1)) / sum(n), 8) AS se FROM m GROUP BY model"""

REPS = 100


def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean from resampled months."""
    return stats.cluster_bootstrap(_blocks(spark, sf_dir), ["model"], "ret", "block", REPS, 0.9, "11").select("model", R("lo", 8).alias("lo"), R("hi", 8).alias("hi"))


_DRAW = "CAST(CAST(concat('0x', substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296"
BOOTSTRAP = f"""WITH {TAPE}, h AS (SELECT model, ts_local_ns // {MONTH_NS} AS block, sum(ret) AS s, count(*) AS n FROM tape GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY model) AS g FROM h),
 d AS (SELECT model, rep, CAST(floor({_DRAW.format(parts="'11', model, CAST(rep AS VARCHAR), CAST(i AS VARCHAR)")} * g) AS BIGINT) AS i FROM c, (SELECT unnest(range(1, {REPS + 1})) AS rep)), m AS (SELECT d.model, rep, sum(s) / sum(n) AS m FROM d JOIN c ON d.model = c.model AND d.i = c.i GROUP BY d.model, rep)
 SELECT model, round(quantile_cont(m, CAST(0.05 AS DOUBLE)), 8) AS lo, round(quantile_cont(m, CAST(0.95 AS DOUBLE)), 8) AS hi FROM m GROUP BY model"""


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Index paths and the monthly series of all models, numbered from 0."""
    s = period_series(spark, sf_dir)
    lo, hi = s.agg(F.min("block"), F.max("block")).first()
    return stats.stationary_paths(hi - lo + 1, 4.0, REPS, "5", spark), s.withColumn("idx", (F.col("block") - lo).cast("int"))


_PATHS = f"""{_SERIES}, o AS (SELECT min(block) AS lo, max(block) - min(block) + 1 AS len FROM ps), q AS (SELECT rep, t, len, t = 0 OR {_DRAW.format(parts="'5', CAST(rep AS VARCHAR), CAST(t AS VARCHAR), 'r'")} < 0.25 AS restart,
 CAST(floor({_DRAW.format(parts="'5', CAST(rep AS VARCHAR), CAST(t AS VARCHAR), 'i'")} * len) AS BIGINT) AS i FROM (SELECT unnest(range(1, {REPS + 1})) AS rep) CROSS JOIN (SELECT unnest(range((SELECT len FROM o))) AS t) CROSS JOIN o),
 w AS (SELECT rep, t, (last_value(CASE WHEN restart THEN i - t END IGNORE NULLS) OVER (PARTITION BY rep ORDER BY t) + t) % len AS idx FROM q), mm AS (SELECT rep, model, avg(round(value, 7)) AS m FROM w JOIN (SELECT model, block - lo AS idx, value FROM ps, o) s USING (idx) GROUP BY rep, model)"""


def stationary_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each model in each resampled history."""
    paths, s = _paths(spark, sf_dir)
    return paths.join(s, "idx").groupBy("rep", "model").agg(R(F.avg("value"), 8).alias("mean"))


def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of two models, interval and one-sided p."""
    paths, s = _paths(spark, sf_dir)
    both = s.groupBy("idx").pivot("model", ["A", "N"]).agg(F.sum("value")).select("idx", (F.col("A") - F.col("N")).alias("d"))
    mean = both.agg(F.avg("d").alias("mean"))
    reps = paths.join(both, "idx").groupBy("rep").agg(F.avg("d").alias("m")).join(F.broadcast(mean))
    return reps.agg(R(F.first("mean"), 8).alias("mean"), R(F.percentile("m", F.lit(0.05)), 8).alias("lo"), R(F.percentile("m", F.lit(0.95)), 8).alias("hi"), R(F.avg((F.col("m") - F.col("mean") >= F.col("mean")).cast("int"))).alias("p"))


PAIRED = f"""WITH {_PATHS}, x AS (SELECT rep, sum(CASE model WHEN 'A' THEN m WHEN 'N' THEN -m ELSE 0 END) AS m FROM mm GROUP BY rep), y AS (SELECT sum(CASE model WHEN 'A' THEN round(value, 7) WHEN 'N' THEN -round(value, 7) ELSE 0 END) / (SELECT len FROM o) AS mean FROM ps)
 SELECT round(any_value(mean), 8) AS mean, round(quantile_cont(m, CAST(0.05 AS DOUBLE)), 8) AS lo, round(quantile_cont(m, CAST(0.95 AS DOUBLE)), 8) AS hi, round(avg(CASE WHEN m - mean >= mean THEN 1 ELSE 0 END), 6) AS p FROM x, y"""


def spa(paths: DataFrame, s: DataFrame, n: int) -> DataFrame:
    """stat, p: whether the best of the series (model, idx, value) over ``n`` periods beats 0, by the consistent test."""
    means = s.groupBy("model").agg((F.sum("value") / n).alias("d"))
    boot = paths.join(s, "idx").groupBy("rep", "model").agg((F.sum("value") / n).alias("m"))
    root, edge = math.sqrt(n), -math.sqrt(2 * math.log(math.log(n)))
    omega = boot.groupBy("model").agg((F.stddev_pop("m") * root).alias("w"))
    ratio = root * F.col("d") / F.col("w")
    each = means.join(omega, "model").withColumn("t", F.greatest(F.lit(0.0), ratio)).withColumn("g", F.when(ratio >= edge, F.col("d")).otherwise(0.0))  # one row a model
    stat = each.agg(F.max("t").alias("stat"))
    top = boot.join(F.broadcast(each), "model").groupBy("rep").agg(F.greatest(F.lit(0.0), F.max(root * (F.col("m") - F.col("g")) / F.col("w"))).alias("b"))
    return top.join(F.broadcast(stat)).agg(R(F.first("stat")).alias("stat"), R(F.avg((F.col("b") >= F.col("stat")).cast("int"))).alias("p"))


def spa_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superior predictive ability of the best model over none, consistent p."""
    paths, s = _paths(spark, sf_dir)
    return spa(paths, s, s.agg(F.max("idx")).first()[0] + 1)


SPA = f"""WITH {_PATHS}, e AS (SELECT model, avg(round(value, 7)) AS d FROM ps GROUP BY model), v AS (SELECT model, stddev_pop(m) * sqrt(any_value(len)) AS w FROM mm, o GROUP BY model),
 a AS (SELECT model, greatest(0, sqrt(len) * d / w) AS t, CASE WHEN sqrt(len) * d / w >= -sqrt(2 * ln(ln(len))) THEN d ELSE 0 END AS g, w, len FROM e JOIN v USING (model), o), bb AS (SELECT rep, greatest(0, max(sqrt(len) * (m - g) / w)) AS b FROM mm JOIN a USING (model) GROUP BY rep), s AS (SELECT max(t) AS stat FROM a)
 SELECT round(any_value(stat), 6) AS stat, round(avg(CASE WHEN b >= stat THEN 1 ELSE 0 END), 6) AS p FROM bb, s"""


def sharpe_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each monthly series that the deflated Sharpe ratio takes."""
    s = period_series(spark, sf_dir)
    return s.groupBy("model").agg(F.count("*").alias("n"), R(F.avg("value") / F.stddev_samp("value")).alias("sharpe"), R(F.skewness("value"), 5).alias("skew"), R(F.kurtosis("value") + 3, 5).alias("kurtosis"))


MOMENTS = f"""WITH {_SERIES}, r AS (SELECT model, round(value, 7) AS x FROM ps), m AS (SELECT *, avg(x) OVER (PARTITION BY model) AS mu FROM r)
 SELECT model, count(*) AS n, round(avg(x) / stddev_samp(x), 6) AS sharpe, round(avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5), 5) AS skew, round(avg(pow(x - mu, 4)) / pow(avg(pow(x - mu, 2)), 2), 5) AS kurtosis FROM m GROUP BY model"""


def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deflated Sharpe ratio of each model, one row a model."""
    rows = sharpe_moments(spark, sf_dir).collect()
    values = [r["sharpe"] for r in rows]
    mean = sum(values) / max(1, len(values))
    variance = sum((v - mean) ** 2 for v in values) / max(1, len(values) - 1)
    out = [(r["model"], stats.deflated_sharpe(r["n"], r["sharpe"], r["skew"], r["kurtosis"], len(rows) * 16, variance)) for r in rows]
    return spark.createDataFrame(out, "model string, dsr double")


def pbo_cscv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank out of sample of the best model in sample, over 70 half-splits."""
    p = stats.pbo(period_series(spark, sf_dir), "block", "model", "value")
    return p.select("combo", "best", R("share").alias("share"), R("logit").alias("logit"))


PBO = f"""WITH {_SERIES}, g AS (SELECT block, ntile(8) OVER (ORDER BY block) AS g FROM (SELECT DISTINCT block FROM ps)), u AS (SELECT g, model, sum(round(value, 7)) AS s, count(*) AS n FROM ps JOIN g USING (block) GROUP BY ALL),
 k AS (SELECT a, b, c, d, CAST(row_number() OVER (ORDER BY a, b, c, d) - 1 AS INTEGER) AS combo FROM (SELECT unnest(range(1, 9)) AS a) CROSS JOIN (SELECT unnest(range(1, 9)) AS b) CROSS JOIN (SELECT unnest(range(1, 9)) AS c) CROSS JOIN (SELECT unnest(range(1, 9)) AS d) WHERE a < b AND b < c AND c < d),
 h AS (SELECT combo, g IN (a, b, c, d) AS inside, model, sum(s) / sum(n) AS m FROM u, k GROUP BY ALL), x AS (SELECT combo, model AS best FROM h WHERE inside QUALIFY row_number() OVER (PARTITION BY combo ORDER BY m DESC, model) = 1),
 y AS (SELECT combo, model, (rank() OVER (PARTITION BY combo ORDER BY m) + (count(*) OVER (PARTITION BY combo, m) - 1) / 2) / (count(*) OVER (PARTITION BY combo) + 1) AS share FROM h WHERE NOT inside)
 SELECT y.combo, best, round(share, 6) AS share, round(ln(share / (1 - share)), 6) AS logit FROM y JOIN x ON y.combo = x.combo AND y.model = x.best"""


def psi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of features between the first four fifths of rows and the rest, largest first."""
    m = matrix(spark, sf_dir)
    cut = m.agg(F.percentile("vec_id", F.lit(0.8)).alias("cut"))
    m = m.join(F.broadcast(cut))
    out = stats.psi(m.where("vec_id <= cut"), m.where("vec_id > cut"), FEATURES)
    return out.select("feature", R("psi").alias("psi")).orderBy(F.desc("psi"), "feature").limit(15)


PSI = f"""WITH {_LONG}, c AS (SELECT quantile_cont(vec_id, 0.8) AS cut FROM mx), e AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [{', '.join(f'{i / 10}' for i in range(11))}]))) AS ed FROM lg, c WHERE vec_id <= cut GROUP BY feature),
 b AS (SELECT feature, vec_id <= cut AS old, greatest(1, least(len(ed) - 1, len(list_filter(ed, lambda v: v <= x)))) AS bin FROM lg JOIN e USING (feature), c), n AS (SELECT feature, bin, count(*) FILTER (old) AS e, count(*) FILTER (NOT old) AS a FROM b GROUP BY ALL),
 p AS (SELECT feature, e, a, e / sum(e) OVER (PARTITION BY feature) + CAST(1e-6 AS DOUBLE) AS p, a / sum(a) OVER (PARTITION BY feature) + CAST(1e-6 AS DOUBLE) AS q FROM n) SELECT feature, CASE WHEN sum(e) >= 100 AND sum(a) >= 100 THEN round(sum((q - p) * ln(q / p)), 6) END AS psi FROM p GROUP BY feature ORDER BY psi DESC, feature LIMIT 15"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows for sizing, from ``part``."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", (F.lit(1000.0) + F.col("p_partkey") % 50).alias("equity"), ((F.col("p_size") - 10) / 10000).alias("mu"), ((F.col("p_partkey") % 5) / 10000).alias("se"), (F.lit(0.002) + F.col("p_partkey") % 3 / 1000).alias("sd"),
        (-F.lit(0.004) - F.col("p_partkey") % 4 / 1000).alias("es"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 4).alias("decimals"), (F.col("p_partkey") % 3 / 10 + 0.1).alias("min_qty"))


CAND = """cand AS (SELECT p_partkey, CAST(1000 AS DOUBLE) + p_partkey % 50 AS equity, (p_size - 10) / CAST(10000 AS DOUBLE) AS mu, (p_partkey % 5) / CAST(10000 AS DOUBLE) AS se, CAST(0.002 AS DOUBLE) + (p_partkey % 3) / CAST(1000 AS DOUBLE) AS sd,
 -CAST(0.004 AS DOUBLE) - (p_partkey % 4) / CAST(1000 AS DOUBLE) AS es, p_retailprice AS price, p_size % 4 AS decimals, (p_partkey % 3) / CAST(10 AS DOUBLE) + CAST(0.1 AS DOUBLE) AS min_qty FROM part)"""


def kelly_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with caps, lots and minimum lifts."""
    k = risk.kelly_size(candidates(spark, sf_dir), 0.25, 1.645, 2.0, 0.02)
    return k.select("p_partkey", R("fraction").alias("fraction"), R("qty").alias("qty"), "size_reason")


KELLY = f"""WITH {CAND}, l AS (SELECT *, mu - CAST(1.645 AS DOUBLE) * se AS lcb FROM cand), f AS (SELECT *, CASE WHEN lcb > 0 THEN least(CAST(0.25 AS DOUBLE) * lcb / (sd * sd), 2, CAST(0.02 AS DOUBLE) / abs(es)) ELSE 0 END AS fraction, least(2, CAST(0.02 AS DOUBLE) / abs(es)) * equity / price AS cap FROM l),
 r AS (SELECT *, floor(CAST(fraction * equity / price AS DECIMAL(28,10)) * CAST(pow(10, decimals) AS DECIMAL(9,0))) / pow(10, decimals) AS raw FROM f)
 SELECT p_partkey, round(fraction, 6) AS fraction, round(CASE WHEN fraction <= 0 THEN 0 WHEN raw >= min_qty THEN raw WHEN min_qty <= cap THEN min_qty ELSE 0 END, 6) AS qty,
 CASE WHEN lcb <= 0 THEN 'ev_lcb_not_positive' WHEN raw >= min_qty THEN 'ok' WHEN min_qty <= cap THEN 'raised_to_exchange_minimum' ELSE 'below_exchange_minimum' END AS size_reason FROM r"""


def lot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lot and tick rounding, smallest feasible quantity."""
    p = table(spark, sf_dir, "part")
    d, price = F.col("p_size") % 4, F.col("p_retailprice")
    return p.select(
        "p_partkey", risk.quantize_down(price / 7, d).alias("qty"), risk.quantize_price(price, d % 2, F.col("p_partkey") % 2 == 0).alias("tick"),
        risk.min_feasible_qty(F.lit(0.005), F.lit(10.0), price, d).alias("min_qty"))


LOTS = """SELECT p_partkey, floor(CAST(p_retailprice / 7 AS DECIMAL(28,10)) * CAST(pow(10, p_size % 4) AS DECIMAL(9,0))) / pow(10, p_size % 4) AS qty,
 (CASE WHEN p_partkey % 2 = 0 THEN floor(CAST(p_retailprice AS DECIMAL(28,10)) * CAST(pow(10, p_size % 4 % 2) AS DECIMAL(9,0))) ELSE ceil(CAST(p_retailprice AS DECIMAL(28,10)) * CAST(pow(10, p_size % 4 % 2) AS DECIMAL(9,0))) END) / pow(10, p_size % 4 % 2) AS tick,
 round(ceil(greatest(CAST(0.005 AS DOUBLE), 10 / p_retailprice) / pow(10.0, -(p_size % 4)) - CAST(1e-9 AS DOUBLE)) * pow(10.0, -(p_size % 4)), 10) AS min_qty FROM part"""


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawdown multiplier and margin state."""
    s = table(spark, sf_dir, "supplier")
    eq = F.col("s_acctbal")
    return s.select("s_suppkey", R(risk.drawdown_multiplier(eq, F.lit(10000.0), 0.1, 0.25)).alias("multiplier"), risk.margin_state(F.lit(3000.0), eq, 0.5, 0.8).alias("margin"))


LIMITS = """SELECT s_suppkey, round(CASE WHEN 1 - s_acctbal / 10000 <= CAST(0.1 AS DOUBLE) THEN 1 WHEN 1 - s_acctbal / 10000 >= CAST(0.25 AS DOUBLE) THEN 0 ELSE (CAST(0.25 AS DOUBLE) - (1 - s_acctbal / 10000)) / (CAST(0.25 AS DOUBLE) - CAST(0.1 AS DOUBLE)) END, 6) AS multiplier,
 CASE WHEN s_acctbal <= 0 OR 3000 / s_acctbal >= CAST(0.8 AS DOUBLE) THEN 'reduce' WHEN 3000 / s_acctbal >= CAST(0.5 AS DOUBLE) THEN 'warn' ELSE 'ok' END AS margin FROM supplier"""


def signal_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failing data check and the choice of execution of each quote."""
    q = quotes(spark, sf_dir)
    c = F.col
    delay = (c("ts_local_ns") - c("ts_exch_ns")) / 1e6
    reason = risk.data_reason(c("bid_px") < c("ask_px"), c("bid_sz") > 1, delay * 40, F.when(c("event_id") % 50 != 0, delay * 20), c("ask_sz"), 3000.0, 9.0)
    choice = risk.execution_choice(c("bid_sz") / 1000, c("ask_sz") / 5000, F.lit(0.6), c("bid_sz") / 800, c("ask_sz") / 8000, c("bid_sz") - 3, c("ask_sz") - 5, delay, F.lit(45.0), c("event_id") % 9, 1.645)
    return q.select("event_id", F.coalesce(reason, F.lit("ok")).alias("reason"), choice.alias("choice"))


CASCADE = f"""WITH {QUOTES}, d AS (SELECT *, (ts_local_ns - ts_exch_ns) / 1e6 AS dl FROM quotes), x AS (SELECT *, bid_sz / 1000 - greatest(0, (bid_sz - 3) / 2 + ask_sz - 5) / 1e4 - CAST(1.645 AS DOUBLE) * (ask_sz / 5000) AS a, CAST(0.6 AS DOUBLE) * (bid_sz / 800 - CAST(1.645 AS DOUBLE) * (ask_sz / 8000)) AS p FROM d)
 SELECT event_id, CASE WHEN NOT (bid_px < ask_px AND bid_sz > 1) THEN 'book_unusable' WHEN dl * 40 > 3000 THEN 'lit_stale' WHEN event_id % 50 = 0 OR dl * 20 > 3000 THEN 'ref_stale' WHEN abs(dl * 40 - dl * 20) > 1500 THEN 'venue_skew' WHEN ask_sz > 9 THEN 'clock_uncertain' ELSE 'ok' END AS reason,
 CASE WHEN event_id % 9 < 2 THEN 'transaction_capacity' WHEN dl > 90 THEN 'latency_degraded' WHEN greatest(a, p) <= 0 THEN 'skip' WHEN p > a THEN 'passive' ELSE 'aggressive' END AS choice FROM x"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    own = F.concat(F.lit("P"), k.cast("string"))
    m = p.select(
        own.alias("symbol"), F.when(k % 13 != 0, F.col("p_retailprice")).alias("last_price"), (F.col("p_size") > 5).alias("active"), (F.col("p_size") * 1000.0).alias("volume"),
        F.when(k % 11 == 0, F.concat(F.lit("OV"), k.cast("string"))).alias("override"), (k % 17 != 0).alias("covered"))
    name = F.concat(F.when(k % 2 == 0, "").otherwise("1000"), own)
    times = F.when(k % 2 == 0, 1.0).otherwise(1000.0) * F.when(k % 7 == 0, 1.5).otherwise(1.0)
    prices = p.where("p_partkey % 5 <> 0").select(name.alias("candidate"), (F.col("p_retailprice") * times).alias("price"))
    prices = prices.unionByName(p.where("p_partkey % 11 = 0").select(F.concat(F.lit("OV"), k.cast("string")).alias("candidate"), F.col("p_retailprice").alias("price")))
    return risk.instrument_mapping(m, prices, 8000.0)


def instrument_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every market mapped to a reference symbol by name and price, or the reason why not."""
    return _mapped(spark, sf_dir)


_MAPPED = """mp AS (SELECT p_partkey AS k, p_size, p_partkey % 11 = 0 OR p_partkey % 5 <> 0 AS priced, p_partkey % 13 <> 0 AND (p_partkey % 11 = 0 OR (p_partkey % 5 <> 0 AND p_partkey % 7 <> 0)) AS fits FROM part),
 mapping AS (SELECT concat('P', k) AS symbol, CASE WHEN fits THEN CASE WHEN k % 11 = 0 THEN concat('OV', k) ELSE concat(CASE WHEN k % 2 = 0 THEN '' ELSE '1000' END, 'P', k) END END AS candidate,
 CASE WHEN fits THEN CASE WHEN k % 11 = 0 OR k % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END END AS multiplier,
 CASE WHEN NOT priced THEN 'not_covered' WHEN NOT fits AND k % 13 = 0 THEN 'no_price' WHEN NOT fits THEN 'price_mismatch' WHEN p_size <= 5 THEN 'inactive' WHEN p_size < 8 THEN 'low_volume' WHEN k % 17 = 0 THEN 'outside_coverage' ELSE 'ok' END AS reason FROM mp)"""
MAPPING = f"WITH {_MAPPED} SELECT symbol, candidate, multiplier, reason = 'ok' AS eligible, reason FROM mapping"


def eligible_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose latest mapping is eligible; some were mapped again later."""
    now = _mapped(spark, sf_dir).select("symbol", F.lit(1).alias("ts"), "eligible")
    again = table(spark, sf_dir, "part").where("p_partkey % 6 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.lit(2).alias("ts"), (F.col("p_partkey") % 4 == 0).alias("eligible"))
    return risk.eligible_symbols(now.unionByName(again))


ELIGIBLE = f"WITH {_MAPPED} SELECT symbol FROM mapping WHERE CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 6 = 0 THEN CAST(substr(symbol, 2) AS BIGINT) % 4 = 0 ELSE reason = 'ok' END"


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of positive latencies, none below 30 samples, and the stressed median."""
    d = quotes(spark, sf_dir).select("symbol", ((F.col("ts_local_ns") - F.col("ts_exch_ns")) / 1e6).alias("d")).where("d > 0")
    n = d.groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 30")
    at = lambda p: F.max(F.when(F.col("q") == p, F.col("value")))
    q = stats.exact_quantiles(d, ["symbol"], "d", [0.5, 0.9, 0.99]).groupBy("symbol").agg(*[at(p).alias(f"q{round(p * 100)}") for p in (0.5, 0.9, 0.99)])
    return n.join(q, "symbol").select("symbol", "n", *[R(f"q{p}", 4).alias(f"p{p}") for p in (50, 90, 99)], R(F.col("q90") / F.col("q50"), 6).alias("stress"))


LATENCY = f"""WITH {QUOTES}, d AS (SELECT symbol, (ts_local_ns - ts_exch_ns) / 1e6 AS d FROM quotes WHERE ts_local_ns > ts_exch_ns)
 SELECT symbol, count(*) AS n, round(quantile_cont(d, 0.5), 4) AS p50, round(quantile_cont(d, 0.9), 4) AS p90, round(quantile_cont(d, 0.99), 4) AS p99, round(quantile_cont(d, 0.9) / quantile_cont(d, 0.5), 6) AS stress FROM d GROUP BY symbol HAVING count(*) >= 30"""


def clock_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock offset of the quickest of the last 64 probes, with its uncertainty."""
    q = quotes(spark, sf_dir).withColumn("rtt", F.col("bid_sz") * 7 + F.col("ask_sz")).withColumn("offset", F.round(F.col("value") - F.col("rtt") / 2, 4))
    best = lambda w: F.min(F.struct("rtt", "event_id", "offset")).over(w.rowsBetween(-63, 0))
    q = rolling(q, ["venue"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY), 64, {"best": best})
    return q.select("event_id", F.col("best.offset").alias("offset_ms"), (F.col("best.rtt") / 2).alias("uncertainty_ms"))


CLOCK = f"""WITH {QUOTES}, p AS (SELECT *, bid_sz * 7 + ask_sz AS rtt FROM quotes), b AS (SELECT event_id, min({{'r': rtt, 'e': event_id, 'o': round(value - rtt / 2, 4)}}) OVER (PARTITION BY venue ORDER BY ts_local_ns, event_id ROWS 63 PRECEDING) AS b FROM p) SELECT event_id, b.o AS offset_ms, b.r / 2 AS uncertainty_ms FROM b"""


def fill_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills counted once by trade id, rolled up to orders (A18, X06's batch twin)."""
    t = table(spark, sf_dir, "lineitem").withColumn("trade_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    one = t.groupBy("l_orderkey", "trade_id").agg(F.min(F.struct("l_quantity", "l_extendedprice", "l_discount", "l_tax")).alias("f"))
    return one.groupBy("l_orderkey").agg(R(F.sum("f.l_quantity"), 4).alias("qty"), R(F.sum("f.l_extendedprice") / F.sum("f.l_quantity"), 10).alias("avg_px"), R(F.sum(F.col("f.l_extendedprice") * F.col("f.l_tax")), 4).alias("fees"), F.count("*").alias("fills"))


FILLS = """WITH o AS (SELECT l_orderkey, l_linenumber, min({'a': l_quantity, 'b': l_extendedprice, 'c': l_discount, 'd': l_tax}) AS f FROM lineitem GROUP BY ALL)
 SELECT l_orderkey, round(sum(f.a), 4) AS qty, round(sum(f.b) / sum(f.a), 10) AS avg_px, round(sum(f.b * f.d), 4) AS fees, count(*) AS fills FROM o GROUP BY l_orderkey"""


def delta_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills from the differences of cumulative order states."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "q").rowsBetween(Window.unboundedPreceding, 0)
    o = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "q")
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.max("l_extendedprice").alias("x"))
    s = t.withColumn("filled", F.sum("q").over(w)).withColumn("quote", F.sum("x").over(w))
    d = F.col("filled") - F.coalesce(F.lag("filled").over(o), F.lit(0.0))
    m = F.col("quote") - F.coalesce(F.lag("quote").over(o), F.lit(0.0))
    return s.withColumn("dq", d).withColumn("dm", m).where("dq > 1e-12").select("l_orderkey", "l_linenumber", R("dq", 4).alias("qty"), R(F.col("dm") / F.col("dq"), 8).alias("px"))


DELTA = "SELECT l_orderkey, l_linenumber, round(min(l_quantity), 4) AS qty, round(max(l_extendedprice) / min(l_quantity), 8) AS px FROM lineitem GROUP BY ALL"


def position_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose own quantity differs from the exchange's, without working orders."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("own"))
    theirs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("theirs"), "o_orderstatus")
    working = theirs.where("o_orderstatus = 'P'").select("k")
    both = own.join(theirs, "k", "full_outer").join(working, "k", "left_anti")
    a, b = F.coalesce("own", F.lit(0.0)), F.coalesce("theirs", F.lit(0.0))
    return both.where(F.abs(a - b) > 0.5).select("k", R(a, 4).alias("own"), R(b, 4).alias("theirs"))


MISMATCH = """WITH a AS (SELECT l_orderkey AS k, sum(l_quantity) AS own FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, floor(o_totalprice / 1000) AS theirs, o_orderstatus FROM orders), j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(own, 0) AS own, coalesce(theirs, 0) AS theirs FROM a FULL JOIN b ON a.k = b.k)
 SELECT k, round(own, 4) AS own, round(theirs, 4) AS theirs FROM j WHERE abs(own - theirs) > 0.5 AND k NOT IN (SELECT k FROM b WHERE o_orderstatus = 'P')"""


def exec_latency_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time from an order to its first print."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t0"))
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("t1"))
    return o.join(f, "o_orderkey").where("t1 > t0").select("o_orderkey", ((F.col("t1") - F.col("t0")) / 1e6).alias("latency_s"))


PRINTS = "SELECT o_orderkey, (min(epoch_us(l_shipdate)) - any_value(epoch_us(o_orderdate))) / 1e6 AS latency_s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING min(epoch_us(l_shipdate)) > any_value(epoch_us(o_orderdate))"


def results_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a result that doesn't depend on row order."""
    t = tape(spark, sf_dir).groupBy("model", "mode").agg(F.count("*").alias("n"))
    line = F.concat_ws("|", "model", "mode", F.col("n").cast("string"))
    return t.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ";"), 256), 1, 16).alias("digest"))


HASH = f"WITH {TAPE}, t AS (SELECT model, mode, count(*) AS n FROM tape GROUP BY ALL) SELECT substr(sha256(array_to_string(list_sort(list(concat_ws('|', model, mode, CAST(n AS VARCHAR)))), ';')), 1, 16) AS digest FROM t"

# the greedy pass as a recursion over features in order, keeping the list of those kept
CHOICE = f"""WITH RECURSIVE {IC}, t AS (SELECT feature, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t FROM ic GROUP BY feature), o AS (SELECT *, row_number() OVER (ORDER BY abs(t) DESC, feature) AS i FROM t),
 rr AS (SELECT vec_id, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS r FROM lg), cc AS (SELECT p.feature AS a, q.feature AS b, round(corr(p.r, q.r), 6) AS c FROM rr p JOIN rr q ON p.vec_id = q.vec_id AND p.feature <> q.feature GROUP BY 1, 2),
 near AS (SELECT a, list(b) AS bs FROM cc WHERE abs(c) >= CAST({REDUNDANT} AS DOUBLE) GROUP BY a),
 g AS (SELECT i, feature, t, true AS kept, CAST(NULL AS VARCHAR) AS redundant_with, [feature] AS ks FROM o WHERE i = 1
  UNION ALL SELECT o.i, o.feature, o.t, over IS NULL, over, CASE WHEN over IS NULL THEN list_append(ks, o.feature) ELSE ks END FROM (SELECT g.i, g.ks, o.i AS ni, list_filter(g.ks, lambda k: list_contains(coalesce(near.bs, []), k))[1] AS over FROM g JOIN o ON o.i = g.i + 1 LEFT JOIN near ON near.a = o.feature) s JOIN o ON o.i = s.ni)
 SELECT feature, t, kept, redundant_with FROM g"""

QUERIES = {
    "feature_screen": (feature_screen, f"WITH {_LONG} SELECT feature, round(avg(CASE WHEN x IS NULL THEN 1 ELSE 0 END), 6) AS missing, round(stddev_pop(x), 6) AS sd, stddev_pop(x) > 1e-12 AS kept FROM lg GROUP BY feature"),
    "block_rank_ic": (block_rank_ic, f"WITH {IC} SELECT feature, block, n, round(ic, 6) AS ic FROM ic"),
    "ic_tstat": (ic_tstat, f"WITH {IC} SELECT feature, count(ic) AS blocks, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t FROM ic GROUP BY feature"),
    "rank_corr_matrix": (rank_corr_matrix, f"WITH {_LONG}, r AS (SELECT vec_id, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS r FROM lg) SELECT p.feature AS a, q.feature AS b, round(corr(p.r, q.r), 6) AS corr FROM r p JOIN r q ON p.vec_id = q.vec_id AND p.feature < q.feature GROUP BY 1, 2"),
    "feature_choice": (feature_choice, CHOICE),
    "ridge_gram": (ridge_gram, GRAM),
    "ridge_fit": (ridge_fit, None),
    "flow_composite": (flow_composite, FLOW),
    "lag_flow": (lag_flow, LAG_FLOW),
    "gated_signal": (gated_signal, GATED),
    "regime_labels": (regime_labels, REGIMES),
    "isotonic_calibrate": (isotonic_calibrate, None),
    "gbt_scores": (gbt_scores, None),
    "walk_forward_folds": (walk_forward_folds, FOLDS),
    "threshold_candidates": (threshold_candidates, THRESHOLDS),
    "decide_side": (decide_side, DECIDE),
    "non_overlap_trades": (non_overlap_trades, NON_OVERLAP),
    "period_series": (period_series, f"WITH {_SERIES} SELECT model, block, round(value, 7) AS value FROM ps"),
    "equity_drawdown": (equity_drawdown, DRAWDOWN),
    "expected_shortfall": (expected_shortfall, ES),
    "regime_breakdown": (regime_breakdown, BREAKDOWN),
    "rejection_summary": (rejection_summary, REJECTIONS),
    "cluster_se": (cluster_se, CLUSTER),
    "cluster_bootstrap_ci": (cluster_bootstrap_ci, BOOTSTRAP),
    "stationary_bootstrap": (stationary_bootstrap, f"WITH {_PATHS} SELECT CAST(rep AS INTEGER) AS rep, model, round(m, 8) AS mean FROM mm"),
    "paired_difference": (paired_difference, PAIRED),
    "spa_test": (spa_test, SPA),
    "sharpe_moments": (sharpe_moments, MOMENTS),
    "deflated_sharpe": (deflated_sharpe, None),
    "pbo_cscv": (pbo_cscv, PBO),
    "psi_drift": (psi_drift, PSI),
    "kelly_size": (kelly_size, KELLY),
    "lot_rules": (lot_rules, LOTS),
    "limits": (limits, LIMITS),
    "signal_cascade": (signal_cascade, CASCADE),
    "instrument_mapping": (instrument_mapping, MAPPING),
    "eligible_symbols": (eligible_symbols, ELIGIBLE),
    "latency_quantiles": (latency_quantiles, LATENCY),
    "purged_windows": (purged_windows, PURGED),
    "clock_offset": (clock_offset, CLOCK),
    "fill_rollup": (fill_rollup, FILLS),
    "delta_fills": (delta_fills, DELTA),
    "position_mismatch": (position_mismatch, MISMATCH),
    "exec_latency_match": (exec_latency_match, PRINTS),
    "results_hash": (results_hash, HASH),
}
