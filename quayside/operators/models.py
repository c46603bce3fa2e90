"""Models for several targets at once, as tables: standardisers, ridge coefficients, boosted trees, thresholds.

A row of the training data has features, one column for each target (side and horizon, null where unknown), its time and its
``place`` in (time, symbol).  Sums of products, never rows, reach the driver: features and targets squared, for each fold and
pattern of missing targets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import exact_quantiles

PENALTIES = (0.1, 1.0, 10.0, 100.0, 1000.0)
#: Rows that both parts need before a penalty is chosen.
ENOUGH = 100
CLIP = 8.0


@dataclass(frozen=True)
class Split:
    """A fold: rows of [start, end) are fitted on; those from ``place`` on judge the penalties."""

    fold: int
    start: int
    end: int
    late: int = 0


def splits(rows: DataFrame, windows: Sequence[tuple[int, int, int]], ts: str) -> list[Split]:
    """Splits of the windows (fold, start, end) of ``rows``: the last quarter of a window's rows, by place, judges."""
    counts = [c for f, s, e in windows for c in (F.count(F.when((F.col(ts) >= s) & (F.col(ts) < e), 1)).alias(f"n{f}"), F.min(F.when(F.col(ts) >= s, F.col("place"))).alias(f"p{f}"))]
    r = rows.agg(*counts).first()
    return [Split(f, s, e, (r[f"p{f}"] or 0) + r[f"n{f}"] * 3 // 4) for f, s, e in windows]


def standardisers(rows: DataFrame, features: Sequence[str], folds: Sequence[Split], ts: str) -> DataFrame:
    """fold, feature, median, mean, sd of each fold's rows: missing values are the median, a constant's deviation is 1."""
    spark = rows.sparkSession
    window = spark.createDataFrame([(s.fold, s.start, s.end) for s in folds], "fold int, __s long, __e long")
    inside = rows.join(F.broadcast(window), (F.col(ts) >= F.col("__s")) & (F.col(ts) < F.col("__e"))).select("fold", *(F.col(f).cast("double").alias(f) for f in features))
    long = inside.select("fold", F.expr("stack({}, {}) AS (feature, x)".format(len(features), ", ".join(f"'{f}', {f}" for f in features))))
    medians = exact_quantiles(long, ["fold", "feature"], "x", [0.5]).select("fold", "feature", F.col("value").alias("median"))
    # a row for each fold and feature
    filled = long.join(F.broadcast(medians), ["fold", "feature"]).withColumn("x", F.coalesce("x", "median"))
    sd = F.stddev_pop("x")
    return filled.groupBy("fold", "feature").agg(F.first("median").alias("median"), F.avg("x").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def masked_sums(rows: DataFrame, features: Sequence[str], targets: Sequence[str], params: DataFrame, folds: Sequence[Split], ts: str) -> DataFrame:
    """fold, target, late, a, b, s: sums of products of standardised features, ``one`` and the target over the rows that have the target.

    One pass: rows of one pattern of missing targets share a block of sums, and a target's sums are those of the patterns that have it.
    """
    names = [*features, "one", *targets]
    fitted = {(r["fold"], r["feature"]): (r["median"], r["mean"], r["sd"]) for r in params.collect()}  # folds times features
    tables = {s.fold: np.array([fitted[s.fold, f] for f in features]).T for s in folds if (s.fold, features[0]) in fitted}
    p, upper = len(features), np.triu_indices(len(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            x, y = b[list(features)].to_numpy(float), b[list(targets)].to_numpy(float)
            t, place, known = b[ts].to_numpy(), b["place"].to_numpy(), ~np.isnan(y)
            pattern = (known << np.arange(len(targets))).sum(1)
            for s in folds:
                inside = (t >= s.start) & (t < s.end)
                if s.fold not in tables or not inside.any():
                    continue
                median, mean, sd = tables[s.fold]
                z = np.clip((np.where(np.isnan(x), median, x) - mean) / sd, -CLIP, CLIP)
                full = np.concatenate((z, np.ones((len(z), 1)), np.where(known, y, 0.0)), axis=1)
                for k in np.unique(pattern[inside]).tolist():
                    for late in (False, True):
                        part = full[inside & (pattern == k) & ((place >= s.late) == late)]
                        if k and len(part):
                            key = (s.fold, k, late)
                            sums[key] = sums.get(key, 0.0) + part.T @ part
        for (fold, k, late), g in sums.items():
            yield pd.DataFrame({"fold": fold, "pattern": k, "late": late, "i": upper[0], "j": upper[1], "s": g[upper]})

    found = rows.select(ts, "place", *features, *targets).mapInPandas(run, "fold int, pattern long, late boolean, i int, j int, s double")
    blocks = found.groupBy("fold", "pattern", "late", "i", "j").agg(F.sum("s").alias("s"))
    has = F.array_compact(F.array(*(F.when((F.col("pattern").bitwiseAND(1 << k) != 0) & (F.col("i") <= F.least(F.col("j"), F.lit(p + 1 + k))) & F.col("i").isin(*range(p + 1), p + 1 + k) & F.col("j").isin(*range(p + 1), p + 1 + k), F.lit(k)) for k in range(len(targets)))))
    name = lambda c: F.when(F.col(c) > p, "y").otherwise(F.get(F.array(*map(F.lit, names)), F.col(c)))
    each = blocks.withColumn("k", F.explode(has)).groupBy("fold", "k", "late", "i", "j").agg(F.sum("s").alias("s"))
    return each.select("fold", F.get(F.array(*map(F.lit, targets)), F.col("k")).alias("target"), "late", name("i").alias("a"), name("j").alias("b"), "s")


def ridge(sums: DataFrame, features: Sequence[str]) -> DataFrame:
    """fold, target, penalty, n, feature, coefficient (feature ``one``: the intercept, which isn't penalised).

    The penalty is the one of the least squared error on the late rows of a fit to the early ones; with too few of either, the
    largest.  Coefficients are those of all rows.
    """
    names = [*features, "one", "y"]
    p, grams = len(features), {}
    for r in sums.collect():  # folds times targets times features squared
        g = grams.setdefault((r["fold"], r["target"]), np.zeros((2, p + 2, p + 2)))[int(r["late"])]
        i, j = names.index(r["a"]), names.index(r["b"])
        g[i, j] = g[j, i] = r["s"]

    def solve(g: np.ndarray, penalty: float) -> np.ndarray:
        n = max(1.0, g[p, p])
        mean, level = g[:p, p] / n, g[p, p + 1] / n
        c = np.linalg.solve(g[:p, :p] - n * np.outer(mean, mean) + penalty * np.eye(p), g[:p, p + 1] - n * mean * level)
        return np.append(c, level - mean @ c)

    def error(g: np.ndarray, w: np.ndarray) -> float:
        return float(g[-1, -1] - 2 * w @ g[: p + 1, -1] + w @ g[: p + 1, : p + 1] @ w)

    out = []
    for (fold, target), (early, late) in sorted(grams.items()):
        enough = early[p, p] > ENOUGH and late[p, p] > ENOUGH
        penalty = min(PENALTIES, key=lambda k: error(late, solve(early, k))) if enough else PENALTIES[-1]
        out += [(fold, target, penalty, int(early[p, p] + late[p, p]), f, float(c)) for f, c in zip(names[: p + 1], solve(early + late, penalty), strict=True)]
    return sums.sparkSession.createDataFrame(out, "fold int, target string, penalty double, n long, feature string, coefficient double")


def linear_score(params: dict[str, tuple[float, float, float]], coefficients: dict[str, float]) -> Column:
    """The score as an expression: {feature: (median, mean, sd)} and {feature: coefficient}."""
    out = F.lit(coefficients["one"])
    for f, (median, mean, sd) in params.items():
        x = (F.coalesce(F.col(f).cast("double"), F.lit(median)) - mean) / sd
        out = out + F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x)) * coefficients[f]
    return out


def fold_scores(rows: DataFrame, params: DataFrame, coefficients: DataFrame, tests: Sequence[tuple[int, int, int]], ts: str, keys: Sequence[str]) -> DataFrame:
    """keys, fold, target, score of the rows in each fold's test window (fold, start, end), which its model has not seen."""
    known, weights = {}, {}
    for r in params.collect():  # folds times features
        known.setdefault(r["fold"], {})[r["feature"]] = (r["median"], r["mean"], r["sd"])
    for r in coefficients.collect():  # folds times targets times features
        weights.setdefault(r["fold"], {}).setdefault(r["target"], {})[r["feature"]] = r["coefficient"]
    fold = F.coalesce(*(F.when((F.col(ts) >= s) & (F.col(ts) < e), F.lit(f)) for f, s, e in tests))
    scored = {t: F.coalesce(*(F.when(F.col("fold") == f, linear_score(known[f], w[t])) for f, w in weights.items() if t in w)) for t in sorted({t for w in weights.values() for t in w})}
    wide = rows.withColumn("fold", fold).where("fold is not null").select(*keys, "fold", *(c.alias(t) for t, c in scored.items()))
    return wide.select(*keys, "fold", F.expr("stack({}, {}) AS (target, score)".format(len(scored), ", ".join(f"'{t}', {t}" for t in scored)))).where("score is not null")


#: Rows that a boosted model needs, and its shape.
LEAST_ROWS, TREES, DEPTH, STEP, LEAST_LEAF = 500, 200, 4, 0.05, 200


def boosted(train: DataFrame, features: Sequence[str], targets: Sequence[str], trees: int = TREES, seed: int = 1, least_rows: int = LEAST_ROWS) -> dict[str, GBTRegressionModel]:
    """A model of boosted trees for each target that has rows enough (M11); missing features must be filled.

    The fits are many small jobs that wait for each other, so targets are fitted side by side.
    """
    if not targets:
        return {}
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(train).select("features", *targets)
    counts = data.agg(*(F.count(t).alias(t) for t in targets)).first()

    def fit(target: str) -> GBTRegressionModel:
        own = data.where(F.col(target).isNotNull()).select("features", F.col(target).alias("label"))
        leaf = max(LEAST_LEAF, counts[target] // 200) if counts[target] >= 4 * LEAST_LEAF else max(1, counts[target] // 20)
        return GBTRegressor(labelCol="label", stepSize=STEP, maxIter=trees, maxDepth=DEPTH, minInstancesPerNode=leaf, seed=seed).fit(own)

    wanted = [t for t in targets if counts[t] >= least_rows]
    with ThreadPoolExecutor(max(1, len(wanted))) as pool:
        return dict(zip(wanted, pool.map(fit, wanted), strict=True))


def boosted_scores(models: dict[str, GBTRegressionModel], rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``score_<target>`` for each model."""
    out = VectorAssembler(inputCols=list(features), outputCol="__features").transform(rows)
    for target, model in models.items():
        out = model.setFeaturesCol("__features").setPredictionCol(f"score_{target}").transform(out)
    return out.drop("__features")


def filled(rows: DataFrame, params: dict[str, tuple[float, float, float]]) -> DataFrame:
    """``rows`` with missing features replaced by their medians."""
    return rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(median)) for f, (median, _, _) in params.items()})


def schema_digest(df: DataFrame, features: Sequence[str]) -> str:
    """A digest of the features' names and types, in their order."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return hashlib.sha256(";".join(f"{f}:{types[f]}" for f in features).encode()).hexdigest()[:16]


#: Tables of a saved model.
TABLES = {
    "about": "name string, mode string, digest string, fit_start long, fit_end long, cal_start long, cal_end long",
    "standardiser": "feature string, position int, median double, mean double, sd double",
    "coefficients": "target string, penalty double, feature string, coefficient double",
    "policy": "side int, target string, horizon_ns long, threshold double, n long, mean double, se double, lcb double"}


class Bundle:
    """A saved model: its tables, read from ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        rows = {name: spark.read.schema(schema).parquet(f"{path}/{name}").collect() for name, schema in TABLES.items()}  # features, targets and sides
        self.about, self.policy = rows["about"][0], rows["policy"]
        self.params = {r["feature"]: (r["median"], r["mean"], r["sd"]) for r in sorted(rows["standardiser"], key=lambda r: r["position"])}
        self.weights: dict[str, dict[str, float]] = {}
        for r in rows["coefficients"]:
            self.weights.setdefault(r["target"], {})[r["feature"]] = r["coefficient"]

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score_<target>``; features of other names or types are an error."""
        if schema_digest(rows, list(self.params)) != self.about["digest"]:
            raise ValueError("the features are not those of the model")
        return rows.withColumns({f"score_{t}": linear_score(self.params, w) for t, w in self.weights.items()})

    def decided(self, rows: DataFrame) -> DataFrame:
        """Scored ``rows`` with side, target, horizon_ns and mu: the side whose score passes and whose calibrated mean is larger, long first."""
        scored = self.scored(rows)
        best = [F.when(F.col(f"score_{p['target']}") >= p["threshold"], F.struct(F.lit(p["mean"]).alias("mu"), F.lit(p["side"]).alias("side"), F.lit(p["target"]).alias("target"), F.lit(p["horizon_ns"]).alias("horizon_ns"))) for p in self.policy]
        choice = F.array_max(F.array_compact(F.array(*best))) if best else F.lit(None).cast("struct<mu:double,side:int,target:string,horizon_ns:bigint>")
        return scored.withColumn("__c", choice).select("*", F.coalesce("__c.side", F.lit(0)).alias("side"), "__c.target", "__c.horizon_ns", "__c.mu").drop("__c")


def save_bundle(path: str, tables: dict[str, DataFrame]) -> None:
    for name, schema in TABLES.items():
        columns = [c.split()[0] for c in schema.split(", ")]
        tables[name].select(columns).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def calibrated(scored: DataFrame, targets: dict[str, tuple[int, int]], block: Column, symbols: int, span_s: float, z: float, least: int, floor: float = 0.0) -> DataFrame:
    """The policy of each side: of its targets {name: (side, horizon_ns)} and eight quantiles of their scores, the threshold of the largest
    min(trades, capacity) times lower bound, where that exceeds ``floor`` (M14)."""
    long = scored.select(block.alias("block"), F.expr("stack({}, {}) AS (target, score, ret)".format(len(targets), ", ".join(f"'{t}', score_{t}, {t}" for t in targets)))).where("ret is not null and score is not null")
    th = exact_quantiles(long, ["target"], "score", [0.1 * k for k in range(1, 9)]).select("target", F.col("q").alias("k"), F.col("value").alias("threshold"))
    hit = long.join(F.broadcast(th), "target").where("score >= threshold")  # eight rows a target
    parts = hit.groupBy("target", "k", "threshold", "block").agg(F.sum("ret").alias("s"), F.count("*").alias("n"))
    total = parts.groupBy("target", "k").agg((F.sum("s") / F.sum("n")).alias("mean"))
    dev = parts.join(total, ["target", "k"]).groupBy("target", "k", "threshold", "mean").agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.pow(F.col("s") - F.col("n") * F.col("mean"), 2)).alias("d"))
    se = F.when(F.col("g") > 1, F.sqrt(F.col("d") * F.col("g") / (F.col("g") - 1)) / F.col("n")).otherwise(F.lit(float("inf")))
    side = scored.sparkSession.createDataFrame([(t, s, h) for t, (s, h) in targets.items()], "target string, side int, horizon_ns long")
    c = dev.withColumn("se", se).withColumn("lcb", F.col("mean") - z * F.col("se")).join(F.broadcast(side), "target").where((F.col("n") >= least) & (F.col("lcb") > floor))
    capacity = symbols * span_s / (F.col("horizon_ns") / 1e9 + 1)
    gain = F.least(F.col("n").cast("double"), capacity) * F.col("lcb")
    best = c.groupBy("side").agg(F.max_by(F.struct("target", "horizon_ns", "threshold", "n", "mean", "se", "lcb"), F.struct(gain, -F.col("k"), "target")).alias("b"))
    return best.select("side", "b.*")
