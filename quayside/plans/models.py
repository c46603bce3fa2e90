"""Queries that fit, save and re-check models for every side and horizon on the grid of the traded venue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scans import lagged, non_overlapping, prefix_scan, uniform
from ..operators import models, stats
from ..sources.tables import shared_path, written
from ..sources.views import DAY, HOUR
from .market import LEAD_LAG, MIDS, lead_lag_features
from .research import R, walk_forward

FEATURES = ["lit_ret_1", "lit_ret_2", "ref_ret_1", "ref_ret_2", "xret_1", "xret_2", "basis_bps"]
#: {target: (side, horizon)}; a horizon is so many grid rows ahead.
TARGETS = {f"{name}_{h}": (side, h * HOUR) for h in (1, 2) for name, side in (("long", 1), ("short", -1))}
COST = 0.0008
LAGS, LAGGED = (4, 20), ("basis_bps", "lit_ret_1")
GAP = 6 * HOUR
KEYS = ["symbol", "ts_ns"]


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows with any label: features, their copies 4 and 20 rows back, net returns by side and horizon, and the place by (ts_ns, symbol)."""
    f = written(lead_lag_features(spark, sf_dir))
    ahead = {f"__r{h}": (f"lit_ret_{h}", -h) for h in (1, 2)}
    back = {f"{c}__lag{k}": (c, k) for c in LAGGED for k in LAGS}
    m = lagged(f, ["symbol"], "ts_ns", HOUR, ahead | back)
    m = m.select(*KEYS, *FEATURES, *back, *(R(F.col(f"__r{h // HOUR}") / 1e4 * side - COST, 10).alias(t) for t, (side, h) in TARGETS.items()), "valid").where("valid").where(F.coalesce(*TARGETS).isNotNull())
    m = prefix_scan(m.withColumn("__one", F.lit(1)), ["__one"], ["ts_ns", "symbol"], F.floor(F.col("ts_ns") / DAY), {"place": ("count", F.lit(1))})
    return written(m.withColumn("place", F.col("place") - 1).drop("__one", "valid"))


def windows(rows: DataFrame) -> list[tuple]:
    """Folds of the rows' span (fold, fit_start, fit_end, cal_start, cal_end, test_start, test_end)."""
    lo, hi = rows.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    return walk_forward(lo, hi + 1, 3, 5 * DAY, 8 * DAY, 0.25, GAP)


def _fitted(rows: DataFrame, folds: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Standardisers and sums of the folds' fit windows."""
    splits = models.splits(rows, [f[:3] for f in folds], "ts_ns")
    params = written(models.standardisers(rows, FEATURES, splits, "ts_ns"))
    return params, models.masked_sums(rows, FEATURES, list(TARGETS), params, splits, "ts_ns")


def ridge_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products for each target of the last fold, early and late rows apart."""
    rows = model_rows(spark, sf_dir)
    _, sums = _fitted(rows, windows(rows)[-1:])
    return sums.select("target", "late", "a", "b", R("s", 4).alias("s"))


_W = "w AS (PARTITION BY symbol ORDER BY ts_ns)"
_ROWS = f"""{MIDS}, f AS ({LEAD_LAG}), d AS (SELECT *, lead(lit_ret_1, 1) OVER w AS r1, lead(lit_ret_2, 2) OVER w AS r2 FROM f WINDOW {_W}),
 v AS (SELECT *, {", ".join(f"round(r{h // HOUR} / 1e4 * {side} - CAST({COST} AS DOUBLE), 10) AS {t}" for t, (side, h) in TARGETS.items())} FROM d WHERE valid), mr AS (SELECT *, row_number() OVER (ORDER BY ts_ns, symbol) - 1 AS place FROM v WHERE coalesce({", ".join(TARGETS)}) IS NOT NULL)"""
#: The fit window of the last fold.
_WINDOW = f"""sp AS (SELECT min(ts_ns) AS t0, max(ts_ns) + 1 AS t1 FROM mr), ce AS (SELECT t0, t1 - 5 * {DAY} - {GAP} AS ce FROM sp), wi AS (SELECT t0, ce - CAST(trunc((ce - t0) * CAST(0.25 AS DOUBLE)) AS BIGINT) - {GAP} AS te FROM ce)"""
_STANDARD = ", ".join(f"greatest(-8, least(8, (coalesce({f}, q_{f}) - m_{f}) / CASE WHEN s_{f} > 0 THEN s_{f} ELSE 1 END)) AS {f}" for f in FEATURES)
MOMENTS = f"""WITH {_ROWS}, {_WINDOW}, ft AS (SELECT mr.* FROM mr, wi WHERE ts_ns >= t0 AND ts_ns < te), q AS (SELECT count(*) * 3 // 4 AS late_from, {", ".join(f"quantile_cont({f}, 0.5) AS q_{f}" for f in FEATURES)} FROM ft),
 m AS (SELECT {", ".join(f"avg(coalesce({f}, q_{f})) AS m_{f}, stddev_pop(coalesce({f}, q_{f})) AS s_{f}" for f in FEATURES)} FROM ft, q), z AS (SELECT place, place >= late_from AS late, {_STANDARD}, CAST(1 AS DOUBLE) AS one, {", ".join(TARGETS)} FROM ft, q, m),
 t AS (SELECT *, y FROM z UNPIVOT (y FOR target IN ({", ".join(TARGETS)}))), l AS (SELECT place, target, late, a, x, CASE a WHEN 'y' THEN 9 WHEN 'one' THEN 8 ELSE list_position([{", ".join(f"'{f}'" for f in FEATURES)}], a) END AS i FROM t UNPIVOT (x FOR a IN ({", ".join(FEATURES)}, one, y)))
 SELECT p.target, p.late, p.a, q.a AS b, round(sum(p.x * q.x), 4) AS s FROM l p JOIN l q ON p.place = q.place AND p.target = q.target AND p.i <= q.i GROUP BY ALL""".replace("SELECT *, y FROM z UNPIVOT", "SELECT * FROM z UNPIVOT")


def ridge_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalty and coefficients for each fold, side and horizon."""
    rows = model_rows(spark, sf_dir)
    _, sums = _fitted(rows, windows(rows))
    return models.ridge(sums, FEATURES)


def ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each fold's test rows by the model that was fitted before them."""
    rows = model_rows(spark, sf_dir)
    folds = windows(rows)
    params, sums = _fitted(rows, folds)
    return models.fold_scores(rows, params, models.ridge(written(sums), FEATURES), [(f[0], f[5], f[6]) for f in folds], "ts_ns", KEYS)


def _window(rows: DataFrame, start: int, end: int) -> DataFrame:
    return rows.where((F.col("ts_ns") >= start) & (F.col("ts_ns") < end))


def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the last fold's test rows by boosted trees for each side and horizon, fitted before them."""
    rows = model_rows(spark, sf_dir)
    fold = windows(rows)[-1]
    params = _medians(rows, fold[1], fold[2], FEATURES)
    train, test = (models.filled(_window(rows, a, b), params) for a, b in (fold[1:3], fold[5:7]))
    fitted = models.boosted(written(train), FEATURES, list(TARGETS))
    scored = models.boosted_scores(fitted, test, FEATURES)
    # a target with too few rows has no model and never trades
    return scored.select(*KEYS, *((F.col(f"score_{t}") if t in fitted else F.lit(None).cast("double")).alias(f"score_{t}") for t in TARGETS))


def _medians(rows: DataFrame, start: int, end: int, features: list[str]) -> dict[str, tuple]:
    split = [models.Split(0, start, end)]
    return {r["feature"]: (r["median"], r["mean"], r["sd"]) for r in models.standardisers(rows, features, split, "ts_ns").collect()}  # one row a feature


#: Rows of a cluster of the gate, and its draws.
CLUSTER_ROWS, DRAWS = 60, 1000


def gate(errors: DataFrame, cluster_rows: int, draws: int, seed: str = "12") -> DataFrame:
    """rows, clusters, gain, p_value, justified of the rows' ``gain`` by ``place`` from 0 and their number ``rows``: contiguous clusters, whose means
    are drawn with replacement; the share of draws whose mean isn't positive (M12)."""
    n = F.greatest(F.lit(2), F.floor(F.col("rows") / cluster_rows)).cast("int")
    c = errors.withColumn("n", n)
    size, more = F.floor(F.col("rows") / F.col("n")), F.col("rows") % F.col("n")
    cluster = F.when(F.col("place") < more * (size + 1), F.floor(F.col("place") / (size + 1))).otherwise(more + F.floor((F.col("place") - more * (size + 1)) / size))
    means = written(c.groupBy("n", cluster.cast("int").alias("k")).agg(F.avg("gain").alias("m"), F.sum("gain").alias("s"), F.count("*").alias("c")))
    draw = means.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("k", F.floor(uniform(seed, F.col("rep"), F.col("k")) * F.col("n")).cast("int")).select("rep", "k")
    boots = draw.join(means.select("k", "m"), "k").groupBy("rep").agg(F.avg("m").alias("b")).agg(F.avg((F.col("b") <= 0).cast("int")).alias("p_value"))
    whole = means.agg(F.sum("c").alias("rows"), F.count("*").alias("clusters"), (F.sum("s") / F.sum("c")).alias("gain"))
    # one row each
    return whole.join(F.broadcast(boots)).withColumn("justified", (F.col("p_value") < 0.05) & (F.col("gain") > 0))


def temporal_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether lagged features earn their place (M12): for each side of the first horizon boosted trees with and without them are fitted to the first
    three quarters of the rows; the fall of the squared error on the last quarter, by row, goes through the gate."""
    rows = model_rows(spark, sf_dir)
    targets = [t for t, (_, h) in TARGETS.items() if h == HOUR]
    lags = [f"{c}__lag{k}" for c in LAGGED for k in LAGS]
    n = rows.count()
    cut = n * 3 // 4
    start, end = rows.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    whole = models.filled(rows, _medians(rows, start, end + 1, [*FEATURES, *lags]))
    train, late = written(whole.where(F.col("place") < cut)), whole.where(F.col("place") >= cut)
    for name, features in (("plain", FEATURES), ("lagged", [*FEATURES, *lags])):
        fitted = models.boosted(train, features, targets)
        targets = list(fitted)  # those with rows enough, the same for both
        late = models.boosted_scores(fitted, late, features).withColumnsRenamed({f"score_{t}": f"{name}_{t}" for t in targets})
    if not targets:  # too few rows for the gate: lags aren't justified
        return spark.createDataFrame([(0, 0, None, None, False)], "rows long, clusters long, gain double, p_value double, justified boolean")
    terms = [F.pow(F.col(f"plain_{t}") - F.col(t), 2) - F.pow(F.col(f"lagged_{t}") - F.col(t), 2) for t in targets]
    known = sum((F.col(t).isNotNull().cast("int") for t in targets), F.lit(0))
    errors = late.where(known > 0).select((F.col("place") - cut).alias("place"), (sum((F.coalesce(x, F.lit(0.0)) for x in terms), F.lit(0.0)) / known).alias("gain"), F.lit(n - cut).alias("rows"))
    return gate(errors, CLUSTER_ROWS, DRAWS)


BLOCK = 6 * HOUR


def refit(rows: DataFrame, path: str, until: int, name: str = "ridge", mode: str = "aggressive") -> None:
    """Fits on the rows before ``until`` but the last 30 % of their time and a gap, calibrates on those, and saves the model under ``path``."""
    seen = rows.where(F.col("ts_ns") < until)
    t0, t1 = seen.agg(F.min("ts_ns"), F.max("ts_ns") + 1).first()
    cal_start = t1 - (t1 - t0) * 3 // 10
    split = models.splits(seen, [(0, t0, cal_start - GAP)], "ts_ns")
    params = written(models.standardisers(seen, FEATURES, split, "ts_ns"))
    weights = models.ridge(models.masked_sums(seen, FEATURES, list(TARGETS), params, split, "ts_ns"), FEATURES)
    spark = rows.sparkSession
    position = spark.createDataFrame(list(enumerate(FEATURES)), "position int, feature string")
    tables = {
        "about": spark.createDataFrame([(name, mode, models.schema_digest(rows, FEATURES), t0, cal_start - GAP, cal_start, t1)], models.TABLES["about"]),
        "standardiser": params.join(position, "feature"), "coefficients": weights,
        "policy": spark.createDataFrame([], models.TABLES["policy"])}
    models.save_bundle(path, tables)
    scored = models.Bundle(spark, path).scored(_window(seen, cal_start, t1))
    symbols = scored.select("symbol").distinct().count()
    policy = models.calibrated(scored, TARGETS, F.floor(F.col("ts_ns") / BLOCK), symbols, (t1 - cal_start) / 1e9, 1.645, 50)
    models.save_bundle(path, tables | {"policy": written(policy)})


def recheck(rows: DataFrame, path: str) -> DataFrame:
    """Trades of the saved model on ``rows`` that it has not seen: side, target, t_open, t_close, mu, ret, one position at a time in a market."""
    bundle = models.Bundle(rows.sparkSession, path)
    unseen = rows.where(F.col("ts_ns") >= bundle.about["cal_end"])
    d = bundle.decided(unseen).where("side <> 0").withColumn("ret", F.coalesce(*(F.when(F.col("target") == t, F.col(t)) for t in TARGETS)))
    d = d.withColumn("t_close", F.col("ts_ns") + F.col("horizon_ns"))
    s = written(d.select("symbol", F.col("place").alias("seq"), F.col("ts_ns").alias("t_open"), "t_close", "side", "target", "mu", "ret"))
    opened = non_overlapping(s.select("symbol", "seq", "t_open", "t_close"), "symbol", "seq", "t_open", "t_close", written, DAY)
    return s.join(opened.select("symbol", "seq"), ["symbol", "seq"])


def model_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model refitted, saved, read in another session and checked on the last five days, which it has not seen."""
    rows, path = model_rows(spark, sf_dir), shared_path(spark, "model")
    last = rows.agg(F.max("ts_ns")).first()[0]
    refit(rows, path, last - 5 * DAY)
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "UTC")
    trades = recheck(other.read.schema(rows.schema).parquet(*rows.inputFiles()), path).where("ret is not null").withColumn("block", F.floor(F.col("t_open") / BLOCK))
    out = trades.groupBy("side", "target").agg(F.count("*").alias("n_trades"), F.avg("ret").alias("mean_net"), F.avg((F.col("ret") > 0).cast("int")).alias("hit_rate"), F.avg("mu").alias("mean_predicted"))
    se = stats.cluster_se(trades, ["side", "target"], "ret", "block").select("side", "target", "clusters", "se")
    # a row for each side, or one without trades; the caller's session reads it
    found = [tuple(r) for r in out.join(se, ["side", "target"]).collect()] or [(None, None, 0, None, None, None, 0, None)]
    return spark.createDataFrame(found, "side int, target string, n_trades long, mean_net double, hit_rate double, mean_predicted double, clusters long, se double")


QUERIES = {
    "ridge_moments": (ridge_moments, MOMENTS),
    "ridge_models": (ridge_models, None),
    "ridge_scores": (ridge_scores, None),
    "boosted_scores": (boosted_scores, None),
    "temporal_model": (temporal_model, None),
    "model_recheck": (model_recheck, None),
}
