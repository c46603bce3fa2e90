"""The report's tables as one set (S19): coverage, quality, folds, models, small accounts, folds of each model, pairs, regimes, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_path, written
from .evaluation import _BY, _D, BY, COMPLEXITY, FOLD, TRADES, trades
from .feeds import stream_quality
from .labels import promotion_checks
from .research import MONTH_NS, R, instrument_mapping, walk_forward_folds

Z = 1.96
#: {kind: (name of the regime beyond the bound, name up to it, column, bound)}
REGIMES = {"latency": ("slow", "fast", "lat_ms", 65.0), "size": ("large", "small", "notional", 40_000.0)}
SUMS = ("ret", "fees", "funding", "slip_bps")


def monthly(t: DataFrame) -> DataFrame:
    """Sums of trades by model, execution, fold, regimes and month: all the report's numbers come from this one scan."""
    kinds = [F.when(F.col(c) > bound, hi).otherwise(lo).alias(k) for k, (hi, lo, c, bound) in REGIMES.items()]
    keys = [*BY, F.floor(F.col("t_entry") / FOLD).alias("fold"), F.floor(F.col("t_entry") / MONTH_NS).alias("block"), *kinds]
    return t.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in SUMS), F.sum(F.greatest("ret", F.lit(0.0))).alias("gain"), F.sum(F.greatest(-F.col("ret"), F.lit(0.0))).alias("loss"))


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades, net result with its interval over months, gross, costs and profit factor of each model and execution: over all, by fold and by regime."""
    m = monthly(trades(spark, sf_dir))
    by = [*BY, "fold", *REGIMES]
    sets = [BY, [*BY, "fold"], *([*BY, k] for k in REGIMES)]
    # grouping sets with the month, then over the months of each set
    cells = m.groupingSets([[F.col(c) for c in (*s, "block")] for s in sets], *(F.col(c) for c in (*by, "block"))).agg(
        F.grouping_id().alias("set"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in (*SUMS, "gain", "loss")))
    cells = written(cells)
    keys = ["set", *by]
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), *(F.sum(c).alias(c) for c in (*SUMS, "gain", "loss")), F.sum(F.col("ret") * F.col("ret")).alias("ss"), F.sum(F.col("ret") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    mean = F.col("ret") / F.col("n")
    dev = F.greatest(F.col("ss") - 2 * mean * F.col("sn") + mean * mean * F.col("nn"), F.lit(0.0))
    se = F.when(F.col("blocks") > 1, F.sqrt(dev * F.col("blocks") / (F.col("blocks") - 1)) / F.col("n"))
    bps = lambda x, d=4: F.round(x * 1e4, d)
    part = F.when(F.col("fold").isNotNull(), "per_fold").when(F.coalesce(*REGIMES).isNotNull(), "regimes").otherwise("models")
    kind = F.coalesce(*(F.when(F.col(k).isNotNull(), k) for k in REGIMES))
    pf = F.when(F.col("loss") > 0, F.round(F.col("gain") / F.col("loss"), 6)).when(F.col("gain") > 0, float("inf"))
    return total.select(
        part.alias("part"), *BY, "fold", kind.alias("kind"), F.coalesce(*REGIMES).alias("regime"), "n", bps(mean).alias("net_bps"), bps(mean - Z * se, 2).alias("lo_bps"), bps(mean + Z * se, 2).alias("hi_bps"),
        bps((F.col("ret") + F.col("fees") - F.col("funding")) / F.col("n")).alias("gross_bps"), bps(F.col("fees") / F.col("n")).alias("fees_bps"), bps(F.col("funding") / F.col("n")).alias("funding_bps"), F.round(F.col("slip_bps") / F.col("n"), 4).alias("slip_bps"), pf.alias("profit_factor"))


def _part(name: str, extra: str, fold: str, kind: str, regime: str) -> str:
    by = _BY + (f", {extra}" if extra else "")
    return f"""SELECT '{name}' AS part, {_BY}, {fold} AS fold, {kind} AS kind, {regime} AS regime, * EXCLUDE ({by}) FROM (
 SELECT {by}, CAST(sum(k) AS BIGINT) AS n, round(any_value(mu) * 1e4, 4) AS net_bps, round((any_value(mu) - {_D(Z)} * sqrt(sum(pow(s - k * mu, 2)) * count(*) / nullif(count(*) - 1, 0)) / sum(k)) * 1e4, 2) AS lo_bps,
  round((any_value(mu) + {_D(Z)} * sqrt(sum(pow(s - k * mu, 2)) * count(*) / nullif(count(*) - 1, 0)) / sum(k)) * 1e4, 2) AS hi_bps, round((sum(s) + sum(fe) - sum(fu)) / sum(k) * 1e4, 4) AS gross_bps, round(sum(fe) / sum(k) * 1e4, 4) AS fees_bps,
  round(sum(fu) / sum(k) * 1e4, 4) AS funding_bps, round(sum(sl) / sum(k), 4) AS slip_bps, CASE WHEN sum(lo) > 0 THEN round(sum(ga) / sum(lo), 6) WHEN sum(ga) > 0 THEN CAST('Infinity' AS DOUBLE) END AS profit_factor
 FROM (SELECT *, sum(s) OVER (PARTITION BY {by}) / sum(k) OVER (PARTITION BY {by}) AS mu FROM (SELECT {by}, block, count(*) AS k, sum(ret) AS s, sum(fees) AS fe, sum(funding) AS fu, sum(slip_bps) AS sl, sum(greatest(ret, 0)) AS ga, sum(greatest(-ret, 0)) AS lo FROM x GROUP BY {by}, block)) GROUP BY {by})"""


_KINDS = ", ".join(f"CASE WHEN {c} > {b} THEN '{hi}' ELSE '{lo}' END AS {k}" for k, (hi, lo, c, b) in REGIMES.items())
PERFORMANCE = f"WITH {TRADES}, x AS (SELECT *, t_entry // {FOLD} AS fold, t_entry // {MONTH_NS} AS block, {_KINDS} FROM tr) " + " UNION ALL BY NAME ".join(
    [_part("models", "", "CAST(NULL AS BIGINT)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"), _part("per_fold", "fold", "fold", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"), *(_part("regimes", k, "CAST(NULL AS BIGINT)", f"'{k}'", k) for k in REGIMES)])

#: Accounts that are looked at, the share of an account that a position takes at most, and the least order.
ACCOUNTS, SHARE, LEAST_ORDER = (50.0, 200.0, 1000.0), 0.2, 25.0


def small_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What accounts of some sizes could have traded: executed and refused signals, why, and the final equity."""
    t = trades(spark, sf_dir).withColumn("wanted", F.col("notional") / 1000).withColumn("initial", F.explode(F.array(*map(F.lit, ACCOUNTS))))
    size = F.least("wanted", F.col("initial") * SHARE)
    t = t.withColumn("size", size).withColumn("reason", F.when(F.col("wanted") < LEAST_ORDER, "signal_too_small").when(F.col("initial") * SHARE < LEAST_ORDER, "below_exchange_minimum"))
    done = F.col("reason").isNull()
    count = lambda c: F.count(F.when(c, 1))
    return t.groupBy(*BY, "initial").agg(
        count(done).alias("executed"), count(F.col("reason") == "signal_too_small").alias("signal_too_small"), count(F.col("reason") == "below_exchange_minimum").alias("below_exchange_minimum"),
        F.round(F.first("initial") + F.coalesce(F.sum(F.when(done, F.col("size") * F.col("ret"))), F.lit(0.0)), 4).alias("final_equity"))


SMALL = f"""WITH {TRADES}, a AS (SELECT *, notional / 1000 AS wanted, unnest([{", ".join(map(_D, ACCOUNTS))}]) AS initial FROM tr), r AS (SELECT *, least(wanted, initial * {_D(SHARE)}) AS size, CASE WHEN wanted < {LEAST_ORDER} THEN 'signal_too_small' WHEN initial * {_D(SHARE)} < {LEAST_ORDER} THEN 'below_exchange_minimum' END AS reason FROM a)
 SELECT {_BY}, initial, count(*) FILTER (reason IS NULL) AS executed, count(*) FILTER (reason = 'signal_too_small') AS signal_too_small, count(*) FILTER (reason = 'below_exchange_minimum') AS below_exchange_minimum, round(any_value(initial) + coalesce(sum(size * ret) FILTER (reason IS NULL), 0), 4) AS final_equity FROM r GROUP BY {_BY}, initial"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of each model's monthly result from the baseline's, by execution, with the deviation of its mean over all months of the span."""
    base = min(COMPLEXITY, key=COMPLEXITY.get)
    month = written(trades(spark, sf_dir).groupBy(*BY, F.floor(F.col("t_entry") / MONTH_NS).alias("block")).agg(F.sum("ret").alias("v")))
    own = month.where(F.col("model") == base).select("exec_mode", "block", F.col("v").alias("b"))
    others = month.where(F.col("model") != base)
    names = others.select(*BY).distinct()
    span = month.agg((F.max("block") - F.min("block") + 1).alias("months"))  # one row
    # months in which only the baseline traded count for every model; models are few
    d = others.select(*BY, "block", F.col("v").alias("d")).unionByName(own.join(names, "exec_mode").select(*BY, "block", (-F.col("b")).alias("d")))
    s = d.groupBy(*BY, "block").agg(F.sum("d").alias("d")).groupBy(*BY).agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss")).join(F.broadcast(span))
    mean = F.col("s") / F.col("months")
    return s.select(*BY, "months", F.round(mean * 1e4, 4).alias("diff_bps"), F.round(F.sqrt(F.greatest(F.col("ss") / F.col("months") - mean * mean, F.lit(0.0)) / F.col("months")) * 1e4, 4).alias("se_bps"))


_BASE = min(COMPLEXITY, key=COMPLEXITY.get)
PAIRS = f"""WITH {TRADES}, mo AS (SELECT {_BY}, t_entry // {MONTH_NS} AS block, sum(ret) AS v FROM tr GROUP BY ALL), sp AS (SELECT max(block) - min(block) + 1 AS months FROM mo), nm AS (SELECT DISTINCT {_BY} FROM mo WHERE model <> '{_BASE}'),
 u AS (SELECT {_BY}, block, v AS d FROM mo WHERE model <> '{_BASE}' UNION ALL SELECT nm.model, nm.exec_mode, block, -v FROM nm JOIN mo ON mo.exec_mode = nm.exec_mode AND mo.model = '{_BASE}'), g AS (SELECT {_BY}, block, sum(d) AS d FROM u GROUP BY ALL),
 s AS (SELECT {_BY}, sum(d) AS s, sum(d * d) AS ss FROM g GROUP BY {_BY}) SELECT {_BY}, months, round(s / months * 1e4, 4) AS diff_bps, round(sqrt(greatest(ss / months - pow(s / months, 2), 0) / months) * 1e4, 4) AS se_bps FROM s, sp"""


def report_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine tables written to one folder and read again: name, rows and columns of each."""
    root = shared_path(spark, "report")
    whole = written(performance(spark, sf_dir))
    tables = {
        "coverage": instrument_mapping(spark, sf_dir), "quality": stream_quality(spark, sf_dir), "folds": walk_forward_folds(spark, sf_dir), "small_accounts": small_accounts(spark, sf_dir), "pairs": pairs(spark, sf_dir), "checks": promotion_checks(spark, sf_dir),
        **{p: whole.where(F.col("part") == p).drop("part") for p in ("models", "per_fold", "regimes")}}
    out = None
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
        one = spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


REPORT_SET = f"""WITH {TRADES}, m AS (SELECT DISTINCT {_BY} FROM tr), x AS (SELECT *, t_entry // {FOLD} AS fold, {_KINDS} FROM tr), q AS (SELECT DISTINCT event_id % 2 AS v, user_id % 8 AS s FROM events WHERE event_type NOT IN ('signup', 'error'))
 SELECT 'coverage' AS name, count(*) AS n, 5 AS columns FROM part UNION ALL SELECT 'quality', count(*), 10 FROM q UNION ALL SELECT 'folds', 15, 4 UNION ALL SELECT 'small_accounts', {len(ACCOUNTS)} * count(*), 7 FROM m UNION ALL SELECT 'pairs', count(*), 5 FROM m WHERE model <> '{_BASE}'
 UNION ALL SELECT 'checks', 5 * count(DISTINCT l_returnflag), 4 FROM lineitem UNION ALL SELECT 'models', count(*), 14 FROM m UNION ALL SELECT 'per_fold', count(*), 14 FROM (SELECT DISTINCT {_BY}, fold FROM x)
 UNION ALL SELECT 'regimes', sum(n), 14 FROM ({" UNION ALL ".join(f"SELECT count(*) AS n FROM (SELECT DISTINCT {_BY}, {k} FROM x)" for k in REGIMES)})"""

QUERIES = {
    "report_performance": (performance, PERFORMANCE),
    "report_small_accounts": (small_accounts, SMALL),
    "report_pairs": (pairs, PAIRS),
    "report_set": (report_set, REPORT_SET),
}
