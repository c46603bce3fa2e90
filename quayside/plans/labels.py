"""Queries over outcomes of decisions, latencies, tops of book and model governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scans import asof_join, interval_join, prefix_scan, rolling
from ..operators import feeds, stats
from ..sources import datasets
from ..sources.tables import shared_path, written
from ..sources.views import DAY, GRID, HOUR, QUOTES, TAPE, grid, quotes, tape
from .feeds import numbered
from .market import LABELS, LEAD_LAG, MIDS, entry_exit_labels, lead_lag_features
from .research import IC, MATRIX, ic_tstat, matrix, placed, tile

MONTH_NS = 30 * DAY
R = lambda c, n=6: F.round(c, n)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts_ns, bid, ask, bid_sz of the traded venue as of each grid row."""
    q = quotes(spark, sf_dir)
    lit = q.where("venue = 'lit'").select("symbol", "ts_local_ns", "event_id", F.col("bid_px").alias("bid"), F.col("ask_px").alias("ask"), F.col("bid_sz").alias("queue"))
    return asof_join(grid(q, HOUR), lit, ["symbol"], "ts_ns", "ts_local_ns", ["bid", "ask", "queue"], DAY, "event_id").where("bid is not null")


_ENTRIES = f"""{QUOTES}, {GRID}, en AS (SELECT g.symbol, g.ts_ns, l.bid, l.ask, l.queue FROM grid g ASOF JOIN (SELECT symbol, ts_local_ns, max_by(bid_px, event_id) AS bid, max_by(ask_px, event_id) AS ask, max_by(bid_sz, event_id) AS queue
 FROM quotes WHERE venue = 'lit' GROUP BY ALL) l ON g.symbol = l.symbol AND g.ts_ns >= l.ts_local_ns)"""


def mae_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst mark against a position inside (t, t + 6 h], capped at 0."""
    e = _entries(spark, sf_dir).withColumn("until", F.col("ts_ns") + 6 * HOUR)
    marks = quotes(spark, sf_dir).where("venue = 'lit'").select("symbol", "ts_local_ns", "bid_px", "ask_px")
    held = interval_join(marks, e, ["symbol"], "ts_local_ns", "ts_ns", "until", 6 * HOUR)
    out = held.groupBy("symbol", "ts_ns", "bid", "ask").agg(F.min("bid_px").alias("lo"), F.max("ask_px").alias("hi"))
    zero = F.lit(0.0)
    return out.select("symbol", "ts_ns", R(F.least(zero, F.col("lo") / F.col("ask") - 1), 8).alias("mae_long"), R(F.least(zero, F.col("bid") / F.col("hi") - 1), 8).alias("mae_short"))


MAE = f"""WITH {_ENTRIES} SELECT e.symbol, e.ts_ns, round(least(0, min(bid_px) / any_value(ask) - 1), 8) AS mae_long, round(least(0, any_value(bid) / max(ask_px) - 1), 8) AS mae_short FROM en e JOIN quotes q
 ON q.symbol = e.symbol AND q.venue = 'lit' AND q.ts_local_ns > e.ts_ns AND q.ts_local_ns <= e.ts_ns + 6 * {HOUR} GROUP BY e.symbol, e.ts_ns"""


def passive_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First time that an order resting at the bid is traded through, or that its queue and itself have traded."""
    e = _entries(spark, sf_dir).withColumn("rest", F.floor("bid")).withColumn("until", F.col("ts_ns") + 24 * HOUR)
    t = quotes(spark, sf_dir).where("venue = 'lit' and event_type = 'purchase'").select("symbol", "ts_local_ns", "event_id", F.floor("bid_px").alias("px"), F.col("ask_sz").alias("sz"))
    held = interval_join(t, e.select("symbol", "ts_ns", "rest", "queue", "until"), ["symbol"], "ts_local_ns", "ts_ns", "until", 24 * HOUR)
    # a resting order sees the trades of its own window only
    w = Window.partitionBy("symbol", "ts_ns").orderBy("ts_local_ns", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.when(F.col("px") == F.col("rest"), F.col("sz")).otherwise(0.0)).over(w)
    held = held.withColumn("at", at).withColumn("hit", (F.col("px") < F.col("rest")) | ((F.col("px") == F.col("rest")) & (F.col("at") >= F.col("queue") + 1)))
    filled = held.groupBy("symbol", "ts_ns").agg(F.min(F.when(F.col("hit"), F.col("ts_local_ns"))).alias("t_fill"))
    last = t.agg(F.max("ts_local_ns").alias("end"))
    out = e.join(filled, ["symbol", "ts_ns"], "left").join(F.broadcast(last))
    state = F.when(F.col("t_fill").isNotNull(), 1).when(F.col("until") <= F.col("end"), 0)
    return out.select("symbol", "ts_ns", state.alias("filled"), R((F.col("t_fill") - F.col("ts_ns")) / 1e9, 3).alias("wait_s"))


PASSIVE = f"""WITH {_ENTRIES}, t AS (SELECT symbol, ts_local_ns, event_id, floor(bid_px) AS px, ask_sz AS sz FROM quotes WHERE venue = 'lit' AND event_type = 'purchase'),
 h AS (SELECT e.symbol, e.ts_ns, t.ts_local_ns, px, floor(bid) AS rest, queue, sum(CASE WHEN px = floor(bid) THEN sz ELSE 0 END) OVER (PARTITION BY e.symbol, e.ts_ns ORDER BY t.ts_local_ns, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM en e JOIN t ON t.symbol = e.symbol AND t.ts_local_ns > e.ts_ns AND t.ts_local_ns <= e.ts_ns + 24 * {HOUR}),
 f AS (SELECT symbol, ts_ns, min(ts_local_ns) AS t_fill FROM h WHERE px < rest OR (px = rest AND seen >= queue + 1) GROUP BY symbol, ts_ns)
 SELECT e.symbol, e.ts_ns, CASE WHEN t_fill IS NOT NULL THEN 1 WHEN e.ts_ns + 24 * {HOUR} <= (SELECT max(ts_local_ns) FROM t) THEN 0 END AS filled, round((t_fill - e.ts_ns) / 1e9, 3) AS wait_s FROM en e LEFT JOIN f ON e.symbol = f.symbol AND e.ts_ns = f.ts_ns"""


def funding_crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding of both sides where a payment lies inside the hold; the rate is that at the exit."""
    g = _entries(spark, sf_dir).select("symbol", "ts_ns").withColumn("t_out", F.col("ts_ns") + 6 * HOUR).withColumn("f0", (F.expr(f"ts_ns DIV {8 * HOUR}") + 1) * (8 * HOUR))
    rates = quotes(spark, sf_dir).where("venue = 'ref'").select("symbol", "ts_local_ns", "event_id", (F.col("value") / 1e6).alias("rate"))
    j = asof_join(g, rates, ["symbol"], "t_out", "ts_local_ns", ["rate"], DAY, "event_id")
    due = (F.col("f0") > F.col("ts_ns")) & (F.col("f0") <= F.col("t_out"))
    return j.select("symbol", "ts_ns", R(F.when(due, -F.col("rate")).otherwise(0.0), 10).alias("fund_long"), R(F.when(due, F.col("rate")).otherwise(0.0), 10).alias("fund_short"))


FUNDING = f"""WITH {_ENTRIES}, r AS (SELECT symbol, ts_local_ns, max_by(value / 1e6, event_id) AS rate FROM quotes WHERE venue = 'ref' GROUP BY ALL), j AS (SELECT e.symbol, e.ts_ns, (e.ts_ns // (8 * {HOUR}) + 1) * 8 * {HOUR} <= t_out AS due, rate FROM (SELECT *, ts_ns + 6 * {HOUR} AS t_out FROM en) e ASOF LEFT JOIN r ON e.symbol = r.symbol AND e.t_out >= r.ts_local_ns)
 SELECT symbol, ts_ns, round(CASE WHEN due THEN -rate ELSE 0 END, 10) AS fund_long, round(CASE WHEN due THEN rate ELSE 0 END, 10) AS fund_short FROM j"""


def top_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touch in force after each message: the last quote, none after a disconnect until the next."""
    q = quotes(spark, sf_dir)
    state = F.when(F.col("event_type") == "signup", F.struct(F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"))).when(F.col("event_type") != "error", F.struct(F.col("bid_px").alias("bid"), F.col("ask_px").alias("ask")))
    s = prefix_scan(q, ["venue", "symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY), {"top": ("last", state), "seen": ("max", (F.col("event_type") == "view").cast("int"))})
    return s.select("event_id", F.col("top.bid").alias("bid"), F.col("top.ask").alias("ask"), F.coalesce(F.col("top.bid") < F.col("top.ask"), F.lit(False)).alias("usable"), F.when(F.col("seen") == 1, "bbo").otherwise("book").alias("source"))


TOPS = f"""WITH {QUOTES}, l AS (SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN {{'b': CAST(NULL AS DOUBLE), 'a': CAST(NULL AS DOUBLE)}} WHEN event_type <> 'error' THEN {{'b': bid_px, 'a': ask_px}} END IGNORE NULLS) OVER w AS t, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS seen
 FROM quotes WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, t.b AS bid, t.a AS ask, coalesce(t.b < t.a, false) AS usable, CASE WHEN seen = 1 THEN 'bbo' ELSE 'book' END AS source FROM l"""


def corrected_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays less the clock offset known at arrival, by stream."""
    q = quotes(spark, sf_dir)
    probes = q.where("event_type = 'click'").select("venue", "ts_local_ns", "event_id", (F.col("value") / 100).alias("offset"))
    j = asof_join(q.select("venue", "symbol", "event_id", "ts_local_ns", "ts_exch_ns").withColumnRenamed("ts_local_ns", "t"), probes, ["venue"], "t", "ts_local_ns", ["offset"], DAY, "event_id")
    d = (F.col("t") - F.col("ts_exch_ns")) / 1e6 - F.coalesce("offset", F.lit(0.0))
    return j.groupBy("venue", "symbol").agg(R(F.percentile(d, F.lit(0.5)), 7).alias("p50"), R(F.percentile(d, F.lit(0.95)), 7).alias("p95"))


DELAYS = f"""WITH {QUOTES}, p AS (SELECT venue, ts_local_ns, max_by(value / 100, event_id) AS o FROM quotes WHERE event_type = 'click' GROUP BY ALL), j AS (SELECT q.venue, q.symbol, (q.ts_local_ns - q.ts_exch_ns) / 1e6 - coalesce(o, 0) AS d FROM quotes q ASOF LEFT JOIN p ON q.venue = p.venue AND q.ts_local_ns >= p.ts_local_ns)
 SELECT venue, symbol, round(quantile_cont(d, 0.5), 7) AS p50, round(quantile_cont(d, 0.95), 7) AS p95 FROM j GROUP BY venue, symbol"""


def latency_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the last 200 samples known, a prior of 400 ms below ten."""
    q = quotes(spark, sf_dir).withColumn("ms", (F.col("ts_local_ns") - F.col("ts_exch_ns")) / 1e6)
    last = lambda w: w.rowsBetween(-199, 0)
    q = rolling(q, ["symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY), 200, {"n": lambda w: F.count("ms").over(last(w)), "m": lambda w: F.percentile("ms", F.lit(0.5)).over(last(w))})
    return q.select("event_id", R(F.when(F.col("n") >= 10, F.col("m")).otherwise(400.0), 4).alias("latency_ms"))


NOW = f"""WITH {QUOTES} SELECT event_id, round(CASE WHEN count(*) OVER w >= 10 THEN quantile_cont((ts_local_ns - ts_exch_ns) / 1e6, 0.5) OVER w ELSE 400 END, 4) AS latency_ms FROM quotes WINDOW w AS (PARTITION BY symbol ORDER BY ts_local_ns, event_id ROWS 199 PRECEDING)"""


def selected_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trades beyond a threshold are like."""
    t = tape(spark, sf_dir).where("price >= 1.2")
    r = F.col("ret")
    return t.groupBy("mode").agg(
        F.count("*").alias("n"), R(F.stddev_samp("ret"), 8).alias("sd"), R(F.avg((r > 0).cast("int"))).alias("p_positive"), R(F.percentile("ret", F.lit(0.05)), 8).alias("q05"), R(F.percentile("ret", F.lit(0.95)), 8).alias("q95"),
        R(F.avg("size")).alias("mean_size"), R(F.avg((F.col("size") > 40).cast("int"))).alias("p_large"), R(F.percentile("price", F.lit(0.5)), 4).alias("median_price"))


PROFILE = f"""WITH {TAPE} SELECT mode, count(*) AS n, round(stddev_samp(ret), 8) AS sd, round(avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END), 6) AS p_positive, round(quantile_cont(ret, 0.05), 8) AS q05, round(quantile_cont(ret, 0.95), 8) AS q95,
 round(avg(size), 6) AS mean_size, round(avg(CASE WHEN size > 40 THEN 1 ELSE 0 END), 6) AS p_large, round(quantile_cont(price, 0.5), 4) AS median_price FROM tape WHERE price >= 1.2 GROUP BY mode"""

CHECKS = (("enough_trades", "n >= 1000"), ("enough_blocks", "clusters >= 20"), ("mean_positive", "mean > 0"), ("bound_positive", "mean - 1.645 * se > 0"), ("not_retired", "NOT (mean + 1.645 * se < 0 AND n >= 30)"))


def promotion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a check and model, and whether all pass; retirement is the last check."""
    c = stats.cluster_se(tape(spark, sf_dir).withColumn("block", F.floor(F.col("ts_local_ns") / MONTH_NS)), ["model"], "ret", "block")
    rows = c.select("model", F.expr("stack({}, {}) AS (check, ok)".format(len(CHECKS), ", ".join(f"'{k}', {e}" for k, e in CHECKS))))
    return rows.withColumn("passes", F.min("ok").over(Window.partitionBy("model")))


PROMOTION = f"""WITH {TAPE}, h AS (SELECT model, ts_local_ns // {MONTH_NS} AS block, sum(ret) AS s, count(*) AS k FROM tape GROUP BY ALL), m AS (SELECT *, sum(s) OVER (PARTITION BY model) / sum(k) OVER (PARTITION BY model) AS mu FROM h),
 c AS (SELECT model, sum(k) AS n, count(*) AS clusters, any_value(mu) AS mean, sqrt(sum(pow(s - k * mu, 2)) * count(*) / (count(*) - 1)) / sum(k) AS se FROM m GROUP BY model),
 r AS ({" UNION ALL ".join(f"SELECT model, '{k}' AS check, {e} AS ok FROM c" for k, e in CHECKS)}) SELECT model, "check", ok, bool_and(ok) OVER (PARTITION BY model) AS passes FROM r"""
PROMOTION = PROMOTION.replace(" AS check,", ' AS "check",')


def waiting_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth messages of both venues with breaks, and with snapshots behind, at and ahead of the updates before them."""
    m = numbered(spark, sf_dir).withColumn("snapshot", F.col("event_type") == "signup").withColumn("last_id", F.col("n") * 10)
    behind = F.when(F.col("event_id") % 3 == 0, 25).when(F.col("event_id") % 3 == 1, 10).otherwise(-5)
    m = m.withColumn("last_id", F.when(F.col("snapshot"), F.col("last_id") - behind).otherwise(F.col("last_id")))
    chained = F.col("last_id") - F.when(F.col("event_id") % 13 == 0, 11).otherwise(10)
    return m.withColumn("first_id", F.col("last_id") - 9).withColumn("prev_id", chained)


def depth_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth updates refused before a snapshot and released at it."""
    return feeds.release_buffered(waiting_messages(spark, sf_dir), ["venue", "symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY)).select("event_id", "state", "at")


CHANGED = "20240110"


def dataset_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature dataset of inputs A, of B in which a row of one day differs, and of A again: each day's rows for A, and how often
    it was built (S14, S15, U01)."""
    root, features = shared_path(spark), lead_lag_features(spark, sf_dir)
    a = quotes(spark, sf_dir)
    first = a.where(datasets.day_of("ts_local_ns") == CHANGED).agg(F.min("event_id")).first()[0]
    b = a.withColumn("bid_sz", F.when(F.col("event_id") == first, F.col("bid_sz") + 1).otherwise(F.col("bid_sz")))
    keys_a, keys_b = written(datasets.day_keys(a)), written(datasets.day_keys(b))
    datasets.write_days(features, root, keys_a)
    changed = F.col("day") == CHANGED
    datasets.write_days(features.withColumn("basis_bps", F.when(datasets.day_of("ts_ns") == CHANGED, -F.col("basis_bps")).otherwise(F.col("basis_bps"))), root, keys_b)
    if datasets.write_days(features, root, keys_a):
        raise ValueError("known days were built again")
    built = datasets.manifest(spark, root).groupBy("day").agg(F.count("*").alias("builds"))
    rows = datasets.read_days(spark, root, keys_a).groupBy("day").agg(F.count("*").alias("n"), R(F.sum("basis_bps"), 4).alias("basis"))
    other = datasets.read_days(spark, root, keys_b).where(changed).agg(R(F.sum("basis_bps"), 4).alias("basis_b"))
    return rows.join(built, "day").join(F.broadcast(other)).select("day", "n", "basis", "builds", F.when(changed, F.col("basis_b")).otherwise(F.col("basis")).alias("basis_b"))


SINK = f"""WITH {MIDS}, f AS ({LEAD_LAG}) SELECT day, count(*) AS n, round(sum(basis_bps), 4) AS basis, CASE WHEN day = '{CHANGED}' THEN 2 ELSE 1 END AS builds, CASE WHEN day = '{CHANGED}' THEN -round(sum(basis_bps), 4) ELSE round(sum(basis_bps), 4) END AS basis_b FROM (SELECT *, strftime(make_timestamp(ts_ns // 1000), '%Y%m%d') AS day FROM f) GROUP BY day"""


def trade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed rows of decided sides with their parts of the return."""
    labels = entry_exit_labels(spark, sf_dir)
    e = _entries(spark, sf_dir).select("symbol", "ts_ns", "bid", "ask", "queue")
    side = F.when(F.col("queue") >= 5, 1).when(F.col("queue") <= 2, -1).otherwise(0)
    j = labels.join(e, ["symbol", "ts_ns"]).withColumn("side", side).where("side <> 0")
    net = F.when(F.col("side") == 1, F.col("net_long")).otherwise(F.col("net_short"))
    return j.where(net.isNotNull()).select(
        "symbol", "side", F.col("ts_ns").alias("t_decision"), F.lit("aggressive").alias("exec_mode"), net.alias("ret"), R((F.col("ask") - F.col("bid")) / (F.col("ask") + F.col("bid")) * 2e4, 5).alias("spread_bps"), "hold_ms")


TRADES = f"""WITH lb AS ({LABELS}), e2 AS (WITH {_ENTRIES} SELECT * FROM en), j AS (SELECT lb.*, bid, ask, CASE WHEN queue >= 5 THEN 1 WHEN queue <= 2 THEN -1 ELSE 0 END AS side FROM lb JOIN e2 USING (symbol, ts_ns))
 SELECT symbol, side, ts_ns AS t_decision, 'aggressive' AS exec_mode, CASE WHEN side = 1 THEN net_long ELSE net_short END AS ret, round((ask - bid) / (ask + bid) * 2e4, 5) AS spread_bps, hold_ms FROM j WHERE side <> 0 AND CASE WHEN side = 1 THEN net_long ELSE net_short END IS NOT NULL"""


def baseline_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookback with the largest signed t statistic of its family, the first of equals."""
    t = ic_tstat(spark, sf_dir).withColumn("family", F.when(F.substring("feature", 2, 2).cast("int") < 4, "momentum").otherwise("lag"))
    w = Window.partitionBy("family").orderBy(F.desc("t"), "feature")
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").select("family", "feature", "t")


BASELINE = f"""WITH {IC}, t AS (SELECT feature, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t FROM ic GROUP BY feature) SELECT family, feature, t FROM (SELECT *, CASE WHEN CAST(substr(feature, 2) AS INTEGER) < 4 THEN 'momentum' ELSE 'lag' END AS family FROM t)
 QUALIFY row_number() OVER (PARTITION BY family ORDER BY t DESC, feature) = 1"""


def temporal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain in squared error of one score over another on the last quarter, by blocks, and whether it is proven."""
    m = placed(matrix(spark, sf_dir).select("vec_id", "target", "f0", "f1"))
    m = m.withColumn("part", tile(F.col("place"), F.col("rows"), 4)).where("part = 4")
    first = (F.col("rows") - F.expr("rows DIV 4")).cast("long")  # places of the last quarter begin here
    m = m.withColumn("block", tile(F.col("place") - first, F.expr("rows DIV 4"), 10))
    gain = F.pow(F.col("target") - F.col("f0"), 2) - F.pow(F.col("target") - F.col("f1"), 2)
    c = stats.cluster_se(m.withColumn("gain", gain).withColumn("all", F.lit(1)), ["all"], "gain", "block")
    return c.select("n", "clusters", R("mean").alias("gain"), R("se").alias("se"), (F.col("mean") > 1.645 * F.col("se")).alias("used"))


GATE = f"""WITH {MATRIX}, p AS (SELECT *, ntile(4) OVER (ORDER BY vec_id) AS part FROM mx), b AS (SELECT *, ntile(10) OVER (ORDER BY vec_id) AS block FROM p WHERE part = 4), h AS (SELECT block, sum(pow(target - f0, 2) - pow(target - f1, 2)) AS s, count(*) AS k FROM b GROUP BY block),
 m AS (SELECT *, sum(s) OVER () / sum(k) OVER () AS mu FROM h), c AS (SELECT CAST(sum(k) AS BIGINT) AS n, count(*) AS clusters, any_value(mu) AS mean, sqrt(sum(pow(s - k * mu, 2)) * count(*) / (count(*) - 1)) / sum(k) AS se FROM m)
 SELECT n, clusters, round(mean, 6) AS gain, round(se, 6) AS se, mean > 1.645 * se AS used FROM c"""

QUERIES = {
    "mae_window": (mae_window, MAE),
    "passive_fill": (passive_fill, PASSIVE),
    "funding_crossed": (funding_crossed, FUNDING),
    "top_source": (top_source, TOPS),
    "corrected_delays": (corrected_delays, DELAYS),
    "latency_now": (latency_now, NOW),
    "selected_profile": (selected_profile, PROFILE),
    "promotion_checks": (promotion_checks, PROMOTION),
    "depth_release": (depth_release, None),
    "dataset_sink": (dataset_sink, SINK),
    "trade_rows": (trade_rows, TRADES),
    "baseline_choice": (baseline_choice, BASELINE),
    "temporal_gate": (temporal_gate, GATE),
}
