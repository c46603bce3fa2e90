"""Queries over quotes, books and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scans import asof_join, asof_scan, ewma, interval_join, lagged, prefix_scan, rolling, uniform
from ..operators import book
from ..sources.tables import written
from ..sources.views import DAY, GRID, HOUR, LEVELS, QUOTES, grid, levels, quotes

R6 = lambda c: F.round(c, 6)


def grid_mids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts_ns, lit_mid, ref_mid, lit_ts, ref_ts on the hourly grid, both venues in one scan."""
    q = quotes(spark, sf_dir)
    seen = F.struct(((F.col("bid_px") + F.col("ask_px")) / 2).alias("mid"), F.col("ts_local_ns").alias("ts"))
    state = asof_scan(grid(q, HOUR), q, ["symbol"], "ts_ns", "ts_local_ns", {v: ("last", F.when(F.col("venue") == v, seen)) for v in ("lit", "ref")}, DAY, "event_id")
    return state.select("symbol", "ts_ns", *[F.col(f"{v}.{c}").alias(f"{v}_{c}") for c in ("mid", "ts") for v in ("lit", "ref")])


MIDS = f"""{QUOTES}, {GRID}, mids AS (SELECT g.symbol, g.ts_ns, l.mid AS lit_mid, r.mid AS ref_mid, l.ts_local_ns AS lit_ts, r.ts_local_ns AS ref_ts FROM grid g
 ASOF LEFT JOIN (SELECT symbol, ts_local_ns, max_by((bid_px + ask_px) / 2, event_id) AS mid FROM quotes WHERE venue = 'lit' GROUP BY ALL) l ON g.symbol = l.symbol AND g.ts_ns >= l.ts_local_ns
 ASOF LEFT JOIN (SELECT symbol, ts_local_ns, max_by((bid_px + ask_px) / 2, event_id) AS mid FROM quotes WHERE venue = 'ref' GROUP BY ALL) r ON g.symbol = r.symbol AND g.ts_ns >= r.ts_local_ns)"""


def lead_lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over two lags of both venues, their difference, basis and validity."""
    m = grid_mids(spark, sf_dir).withColumn("at", F.col("ts_ns"))
    m = lagged(m, ["symbol"], "ts_ns", HOUR, {f"__{v}{k}": (f"{v}_mid", k) for v in ("lit", "ref") for k in (1, 2)} | {"__at2": ("at", 2)})
    ret = lambda v, k: F.log(F.col(f"{v}_mid") / F.col(f"__{v}{k}")) * 1e4
    return m.select(
        "symbol", "ts_ns",
        *[R6(ret(v, k)).alias(f"{v}_ret_{k}") for v in ("lit", "ref") for k in (1, 2)],
        *[R6(ret("ref", k) - ret("lit", k)).alias(f"xret_{k}") for k in (1, 2)],
        R6(F.log(F.col("lit_mid") / F.col("ref_mid")) * 1e4).alias("basis_bps"),
        F.coalesce((F.col("ts_ns") - F.col("lit_ts") <= 4 * HOUR) & (F.col("ts_ns") - F.col("ref_ts") <= 4 * HOUR) & F.col("__at2").isNotNull(), F.lit(False)).alias("valid"))


_RET = "ln({v}_mid / lag({v}_mid, {k}) OVER w) * 1e4"
LEAD_LAG = (
    "SELECT symbol, ts_ns, " + ", ".join(f"round({_RET.format(v=v, k=k)}, 6) AS {v}_ret_{k}" for v in ("lit", "ref") for k in (1, 2)) + ", "
    + ", ".join(f"round({_RET.format(v='ref', k=k)} - {_RET.format(v='lit', k=k)}, 6) AS xret_{k}" for k in (1, 2))
    + f", round(ln(lit_mid / ref_mid) * 1e4, 6) AS basis_bps, coalesce(ts_ns - lit_ts <= 4 * {HOUR} AND ts_ns - ref_ts <= 4 * {HOUR} AND row_number() OVER w > 2, false) AS valid FROM mids WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns)")


def lead_lag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, valid share and correlation of the lagged cross return with the next traded return, by symbol."""
    f = lagged(lead_lag_features(spark, sf_dir), ["symbol"], "ts_ns", HOUR, {"next": ("lit_ret_1", -1)})
    return f.groupBy("symbol").agg(F.count("*").alias("n"), R6(F.avg(F.col("valid").cast("int"))).alias("valid_share"), R6(F.corr("xret_1", "next")).alias("corr_next"))


def asof_grid_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = grid_mids(spark, sf_dir)
    return m.select("symbol", "ts_ns", R6("lit_mid").alias("lit_mid"), R6("ref_mid").alias("ref_mid"), "lit_ts", "ref_ts")


def prefix_sum_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running signed volume, trades and last funding value of a stream."""
    q = quotes(spark, sf_dir)
    trade = F.col("event_type") == "purchase"
    out = prefix_scan(q, ["venue", "symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY), {
        "flow": ("sum", F.when(trade, F.col("bid_sz") - F.col("ask_sz"))), "trades": ("count", F.when(trade, 1)), "last_value": ("last", F.when(trade, F.col("value"))), "high": ("max", F.col("ask_px"))})
    return out.select("event_id", R6("flow").alias("flow"), "trades", "last_value", "high")


PREFIX = f"""WITH {QUOTES} SELECT event_id, coalesce(round(sum(CASE WHEN event_type = 'purchase' THEN bid_sz - ask_sz END) OVER w, 6), 0) AS flow,
 count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER w AS trades, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_value, max(ask_px) OVER w AS high
 FROM quotes WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id ROWS UNBOUNDED PRECEDING)"""


def window_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes inside (t, t + 3 h] of each grid row: count, best bid, worst ask."""
    q = quotes(spark, sf_dir).where("venue = 'lit'")
    spans = grid(quotes(spark, sf_dir), HOUR).withColumn("until", F.col("ts_ns") + 3 * HOUR)
    held = interval_join(q.select("symbol", "ts_local_ns", "bid_px", "ask_px"), spans, ["symbol"], "ts_local_ns", "ts_ns", "until", 3 * HOUR)
    return held.groupBy("symbol", "ts_ns").agg(F.count("*").alias("n"), F.max("bid_px").alias("best_bid"), F.max("ask_px").alias("worst_ask"))


MARKS = f"""WITH {QUOTES}, {GRID} SELECT g.symbol, g.ts_ns, count(*) AS n, max(bid_px) AS best_bid, max(ask_px) AS worst_ask FROM grid g JOIN quotes q
 ON g.symbol = q.symbol AND q.ts_local_ns > g.ts_ns AND q.ts_local_ns <= g.ts_ns + 3 * {HOUR} WHERE q.venue = 'lit' GROUP BY g.symbol, g.ts_ns"""

ALPHA = 0.02
#: A variance up to here is rounding noise of a constant.
NO_VARIANCE = 1e-12


def _quote_mids(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotes(spark, sf_dir).where("venue = 'lit'")
    return q.select("symbol", "event_id", "ts_local_ns", ((F.col("bid_px") + F.col("ask_px")) / 2).alias("mid"))


def ewma_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted mid of each symbol."""
    out = ewma(_quote_mids(spark, sf_dir), ["symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY), ALPHA, "mid", "mean")
    return out.select("event_id", R6("mean").alias("mean"))


_NUMBERED = f"""{QUOTES}, m AS (SELECT symbol, event_id, ts_local_ns, (bid_px + ask_px) / 2 AS mid, row_number() OVER (PARTITION BY symbol ORDER BY ts_local_ns, event_id) - 1 AS i FROM quotes WHERE venue = 'lit'),
 e AS (SELECT *, pow({1 - ALPHA}, i) * sum((CASE WHEN i = 0 THEN 1 ELSE {ALPHA} END) * mid * pow({1 - ALPHA}, -i)) OVER (PARTITION BY symbol ORDER BY i) AS mean FROM m),
 d AS (SELECT *, mid - lag(mean) OVER (PARTITION BY symbol ORDER BY i) AS dev FROM e),
 v AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE pow({1 - ALPHA}, i) * sum({ALPHA} * dev * dev * {1 - ALPHA} * pow({1 - ALPHA}, -i)) OVER (PARTITION BY symbol ORDER BY i) END AS var FROM d)"""


def ewma_variance(df: DataFrame, keys: list[str], order: list[str], bucket, alpha: float, x: str, out: str) -> DataFrame:
    """``df`` with mean, dev (from the mean before), n (values so far) and the variance around the mean before each value.

    Each scan reads its input twice, so what a scan gives is written before the next one."""
    m = written(ewma(df, keys, order, bucket, alpha, x, f"{out}_mean", count=f"{out}_n"))
    m = prefix_scan(m, keys, order, bucket, {"__before": ("last<", F.col(f"{out}_mean"))}).withColumn(f"{out}_dev", F.col(x) - F.col("__before")).drop("__before")
    m = written(m.withColumn("__sq", F.when(F.col(x).isNotNull(), (1 - alpha) * F.coalesce(F.col(f"{out}_dev") * F.col(f"{out}_dev"), F.lit(0.0)))))
    return written(ewma(m, keys, order, bucket, alpha, "__sq", f"{out}_var", seed_zero=True).drop("__sq"))


def ewma_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted variance around the mean before each value."""
    v = ewma_variance(_quote_mids(spark, sf_dir), ["symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY), ALPHA, "mid", "mid")
    return v.select("event_id", R6("mid_var").alias("var"))


def basis_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of the basis against its mean and variance before it, from the 21st value on."""
    m = written(grid_mids(spark, sf_dir).withColumn("basis", F.log(F.col("lit_mid") / F.col("ref_mid")) * 1e4))
    order, bucket = ["ts_ns"], F.floor(F.col("ts_ns") / (30 * DAY))
    v = ewma_variance(m, ["symbol"], order, bucket, ALPHA, "basis", "basis")
    v = prefix_scan(v, ["symbol"], order, bucket, {"var_before": ("last<", F.col("basis_var"))})
    z = F.when((F.col("basis_n") > 20) & (F.col("var_before") > NO_VARIANCE), F.col("basis_dev") / F.sqrt("var_before"))
    return v.select("symbol", "ts_ns", F.round(z, 5).alias("z"))


BASIS_Z = f"""WITH {MIDS}, b AS (SELECT symbol, ts_ns, ln(lit_mid / ref_mid) * 1e4 AS x FROM mids), m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) - 1 AS i FROM b WHERE x IS NOT NULL),
 e AS (SELECT *, pow({1 - ALPHA}, i) * sum((CASE WHEN i = 0 THEN 1 ELSE {ALPHA} END) * x * pow({1 - ALPHA}, -i)) OVER (PARTITION BY symbol ORDER BY i) AS mean FROM m), d AS (SELECT *, x - lag(mean) OVER (PARTITION BY symbol ORDER BY i) AS dev FROM e),
 v AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE pow({1 - ALPHA}, i) * sum({ALPHA} * dev * dev * {1 - ALPHA} * pow({1 - ALPHA}, -i)) OVER (PARTITION BY symbol ORDER BY i) END AS var FROM d), z AS (SELECT *, lag(var) OVER (PARTITION BY symbol ORDER BY i) AS vb FROM v)
 SELECT b.symbol, b.ts_ns, round(CASE WHEN i >= 20 AND vb > CAST({NO_VARIANCE} AS DOUBLE) THEN dev / sqrt(vb) END, 5) AS z FROM b LEFT JOIN z ON b.symbol = z.symbol AND b.ts_ns = z.ts_ns"""

#: Delays that a rolling median looks at.
DELAYS_SEEN = 512


def rolling_median_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank median of the last 512 arrival delays of a stream."""
    q = quotes(spark, sf_dir).withColumn("delay", (F.col("ts_local_ns") - F.col("ts_exch_ns")) / 1e6)
    last = lambda w: F.sort_array(F.collect_list("delay").over(w.rowsBetween(1 - DELAYS_SEEN, 0)))
    q = rolling(q, ["venue", "symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY), DELAYS_SEEN, {"last": last})
    return q.select("event_id", F.get("last", F.bround(0.5 * (F.size("last") - 1)).cast("int")).alias("delay_ms"))


ROLLING = f"""WITH {QUOTES}, d AS (SELECT event_id, list_sort(list((ts_local_ns - ts_exch_ns) / 1e6) OVER (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id ROWS {DELAYS_SEEN - 1} PRECEDING)) AS l FROM quotes)
 SELECT event_id, l[CAST(round_even(0.5 * (len(l) - 1), 0) AS INTEGER) + 1] AS delay_ms FROM d"""


def obi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalance at the touch, spread and microprice."""
    q = quotes(spark, sf_dir)
    b, a = F.col("bid_sz"), F.col("ask_sz")
    mid = (F.col("bid_px") + F.col("ask_px")) / 2
    return q.select("event_id", R6((b - a) / (b + a + 1e-12)).alias("obi"), R6((F.col("ask_px") - F.col("bid_px")) / mid * 1e4).alias("spread_bps"), R6(book.microprice("bid_px", "bid_sz", "ask_px", "ask_sz")).alias("micro"))


OBI = f"""WITH {QUOTES} SELECT event_id, round((bid_sz - ask_sz) / (bid_sz + ask_sz + CAST(1e-12 AS DOUBLE)), 6) AS obi, round((ask_px - bid_px) / ((bid_px + ask_px) / 2) * 1e4, 6) AS spread_bps,
 round((bid_px * ask_sz + ask_px * bid_sz) / (bid_sz + ask_sz), 6) AS micro FROM quotes"""


def with_flow(q: DataFrame) -> DataFrame:
    """Quotes with ``ofi``, cumulated over a stream; nothing is compared across a snapshot of the traded venue's book."""
    order, bucket = ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY)
    snapshot = ((F.col("venue") == "lit") & (F.col("event_type") == "signup")).cast("int")
    q = prefix_scan(q, ["venue", "symbol"], order, bucket, {"__part": ("sum", snapshot)})
    return book.order_flow(q, ["venue", "symbol"], order, bucket, "__part").drop("__part")


def ofi_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-flow imbalance of top changes, cumulated over a stream."""
    return with_flow(quotes(spark, sf_dir)).select("event_id", R6("ofi").alias("ofi"))


_OFI = f"""{QUOTES}, sg AS (SELECT *, sum(CASE WHEN venue = 'lit' AND event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id ROWS UNBOUNDED PRECEDING) AS part FROM quotes),
 ol AS (SELECT *, lag(bid_px) OVER w AS b0, lag(bid_sz) OVER w AS bs0, lag(ask_px) OVER w AS a0, lag(ask_sz) OVER w AS as0 FROM sg WINDOW w AS (PARTITION BY venue, symbol, part ORDER BY ts_local_ns, event_id)),
 fl AS (SELECT *, sum(CASE WHEN b0 IS NULL THEN 0 ELSE (CASE WHEN bid_px >= b0 THEN bid_sz ELSE 0 END) - (CASE WHEN bid_px <= b0 THEN bs0 ELSE 0 END) - (CASE WHEN ask_px <= a0 THEN ask_sz ELSE 0 END) + (CASE WHEN ask_px >= a0 THEN as0 ELSE 0 END) END)
 OVER (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id ROWS UNBOUNDED PRECEDING) AS ofi FROM ol)"""
OFI = f"WITH {_OFI} SELECT event_id, round(ofi, 6) AS ofi FROM fl"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts_ns, r: log return of the reference mid over one grid row."""
    m = lagged(grid_mids(spark, sf_dir), ["symbol"], "ts_ns", HOUR, {"__old": ("ref_mid", 1)})
    return m.select("symbol", "ts_ns", F.log(F.col("ref_mid") / F.col("__old")).alias("r"))


def vol_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility over the last 24 rows, its ratio to 96 rows, and the trend in its units."""
    m = _returns(spark, sf_dir).withColumn("r", F.col("r") * 1e4)
    frame = lambda w, n: w.rowsBetween(1 - n, 0)
    m = rolling(m, ["symbol"], ["ts_ns"], F.floor(F.col("ts_ns") / (30 * DAY)), 96, {
        "s": lambda w: F.sqrt(F.avg(F.col("r") * F.col("r")).over(frame(w, 24))), "l": lambda w: F.sqrt(F.avg(F.col("r") * F.col("r")).over(frame(w, 96))), "t": lambda w: F.sum("r").over(frame(w, 24))})
    zero = F.lit(0.0)
    return m.select("symbol", "ts_ns", R6("s").alias("rv"), R6(F.col("s") / F.nullif("l", zero)).alias("vol_ratio"), R6(F.col("t") / F.nullif(F.col("s") * F.sqrt(F.lit(24.0)), zero)).alias("trend"))


VOL = f"""WITH {MIDS}, r AS (SELECT symbol, ts_ns, ln(ref_mid / lag(ref_mid) OVER (PARTITION BY symbol ORDER BY ts_ns)) * 1e4 AS r FROM mids),
 a AS (SELECT *, sqrt(avg(r * r) OVER (PARTITION BY symbol ORDER BY ts_ns ROWS 23 PRECEDING)) AS s, sqrt(avg(r * r) OVER (PARTITION BY symbol ORDER BY ts_ns ROWS 95 PRECEDING)) AS l, sum(r) OVER (PARTITION BY symbol ORDER BY ts_ns ROWS 23 PRECEDING) AS t FROM r)
 SELECT symbol, ts_ns, round(s, 6) AS rv, round(s / nullif(l, 0), 6) AS vol_ratio, round(t / nullif(s * sqrt(24), 0), 6) AS trend FROM a"""


def lag_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a feature 4 and 20 grid rows back."""
    m = lagged(grid_mids(spark, sf_dir), ["symbol"], "ts_ns", HOUR, {f"lit_mid__lag{k}": ("lit_mid", k) for k in (4, 20)})
    return m.select("symbol", "ts_ns", *[R6(f"lit_mid__lag{k}").alias(f"lit_mid__lag{k}") for k in (4, 20)])


LAGS = f"WITH {MIDS} SELECT symbol, ts_ns, round(lag(lit_mid, 4) OVER w, 6) AS lit_mid__lag4, round(lag(lit_mid, 20) OVER w, 6) AS lit_mid__lag20 FROM mids WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns)"


#: Ticks after which a product of returns has half its weight, and the variances that the weights start from.
HALFLIFE, FIRST_VARIANCE = 48, 1e-8


def pair_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tick, a, b, ra, rb, n: returns of each two symbols at every tick of the whole span, 0 where one is missing."""
    r = _returns(spark, sf_dir)
    span = r.agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi"))
    # one row of the span, few symbols
    calendar = r.select("symbol").distinct().join(F.broadcast(span)).select("symbol", ((F.col("hi") - F.col("lo")) / HOUR + 1).cast("long").alias("n"), F.explode(F.sequence("lo", "hi", F.lit(HOUR))).alias("ts_ns"), ((F.col("ts_ns") - F.col("lo")) / HOUR).cast("long").alias("tick"))
    each = calendar.join(r, ["symbol", "ts_ns"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    a, b = each.select("tick", "n", F.col("symbol").alias("a"), F.col("r").alias("ra")), each.select("tick", F.col("symbol").alias("b"), F.col("r").alias("rb"))
    # as many pairs as symbols squared at a tick: symbols are few
    return a.join(b, "tick").where("a < b")


def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of two symbols from exponentially weighted products of their returns, 0.5 below 100 ticks."""
    keep = 0.5 ** (1 / HALFLIFE)
    weighted = lambda x: F.sum((1 - keep) * F.pow(F.lit(keep), F.col("n") - 1 - F.col("tick")) * x)
    start = F.pow(F.lit(keep), F.max("n")) * FIRST_VARIANCE
    aa, bb = start + weighted(F.col("ra") * F.col("ra")), start + weighted(F.col("rb") * F.col("rb"))
    corr = weighted(F.col("ra") * F.col("rb")) / F.sqrt(aa * bb)
    return pair_returns(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("n"), R6(F.when(F.count("*") >= 100, corr).otherwise(0.5)).alias("corr"))


_KEEP = f"pow(CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE) / {HALFLIFE})"
PAIRS = f"""WITH {MIDS}, r AS (SELECT symbol, ts_ns, ln(ref_mid / lag(ref_mid) OVER (PARTITION BY symbol ORDER BY ts_ns)) AS r FROM mids), s AS (SELECT min(ts_ns) AS lo, (max(ts_ns) - min(ts_ns)) // {HOUR} + 1 AS n FROM r),
 p AS (SELECT x.symbol AS a, y.symbol AS b, sum((1 - {_KEEP}) * pow({_KEEP}, n - 1 - (x.ts_ns - lo) // {HOUR}) * x.r * y.r) AS ab FROM s, r x JOIN r y ON x.ts_ns = y.ts_ns AND x.symbol < y.symbol GROUP BY 1, 2),
 v AS (SELECT symbol, pow({_KEEP}, any_value(n)) * CAST({FIRST_VARIANCE} AS DOUBLE) + coalesce(sum((1 - {_KEEP}) * pow({_KEEP}, n - 1 - (ts_ns - lo) // {HOUR}) * r * r), 0) AS v, any_value(n) AS n FROM s, r GROUP BY symbol)
 SELECT x.symbol AS a, y.symbol AS b, x.n AS n, round(CASE WHEN x.n >= 100 THEN coalesce(ab, 0) / sqrt(x.v * y.v) ELSE 0.5 END, 6) AS corr FROM v x JOIN v y ON x.symbol < y.symbol LEFT JOIN p ON p.a = x.symbol AND p.b = y.symbol"""


def level_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.level_intervals(levels(spark, sf_dir))


INTERVALS = f"""{LEVELS}, iv AS (SELECT * FROM (SELECT symbol, epoch, side, price, size, seq, ts_local_ns AS valid_from, lead(ts_local_ns) OVER (PARTITION BY symbol, epoch, side, price ORDER BY ts_local_ns, seq) AS valid_to FROM levels) WHERE size > 0)"""

#: Time buckets in which intervals of levels meet the instants.
WEEK = 7 * DAY


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every midnight inside an epoch of a symbol."""
    span = levels(spark, sf_dir).groupBy("symbol", "epoch").agg(F.floor(F.min("ts_local_ns") / DAY).alias("lo"), F.floor(F.max("ts_local_ns") / DAY).alias("hi")).where("hi > lo")
    return span.select("symbol", "epoch", F.explode(F.sequence((F.col("lo") + 1) * DAY, F.col("hi") * DAY, F.lit(DAY))).alias("t"))


_INSTANTS = f"""instants AS (SELECT symbol, epoch, unnest(range(min(ts_local_ns) // {DAY} + 1, max(ts_local_ns) // {DAY} + 1)) * {DAY} AS t FROM levels GROUP BY symbol, epoch),
 bk AS (SELECT i.symbol, i.epoch, i.t, side, price, size FROM instants i JOIN iv ON i.symbol = iv.symbol AND i.epoch = iv.epoch AND i.t >= valid_from AND (valid_to IS NULL OR i.t < valid_to))"""
_BOOK = f"WITH {INTERVALS}, {_INSTANTS}"


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.book_at(level_intervals(spark, sf_dir), _instants(spark, sf_dir), WEEK)


def book_asof_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bid and ask with sizes, mid and usability at each instant."""
    t = book.top(_book(spark, sf_dir))
    return t.select("symbol", "epoch", "t", "bid_px", "bid_sz", "ask_px", "ask_sz", R6((F.col("bid_px") + F.col("ask_px")) / 2).alias("mid"), F.coalesce(F.col("bid_px") < F.col("ask_px"), F.lit(False)).alias("usable"))


TOP = f"""{_BOOK} SELECT symbol, epoch, t, max(price) FILTER (side = 'bid') AS bid_px, arg_max(size, price) FILTER (side = 'bid') AS bid_sz, min(price) FILTER (side = 'ask') AS ask_px, arg_min(size, price) FILTER (side = 'ask') AS ask_sz,
 round((max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2, 6) AS mid, coalesce(max(price) FILTER (side = 'bid') < min(price) FILTER (side = 'ask'), false) AS usable FROM bk GROUP BY symbol, epoch, t"""


def book_depth_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notional within 50 bps of the mid and quantity of the five best levels."""
    b = _book(spark, sf_dir)
    mids = book.top(b).select("symbol", "epoch", "t", ((F.col("bid_px") + F.col("ask_px")) / 2).alias("mid"))
    deep = book.ranked(b).groupBy("symbol", "epoch", "t", "side").agg(F.sum(F.when(F.col("rank") <= 5, F.col("size"))).alias("qty5"))
    band = b.join(mids, ["symbol", "epoch", "t"]).groupBy("symbol", "epoch", "t", "side").agg(F.sum(F.when(F.abs(F.col("price") - F.col("mid")) <= F.col("mid") * 0.005 + 1e-9, F.col("price") * F.col("size")).otherwise(0.0)).alias("notional"))
    return band.join(deep, ["symbol", "epoch", "t", "side"]).select("symbol", "epoch", "t", "side", F.round("notional", 7).alias("notional"), F.round("qty5", 5).alias("qty5"))


BAND = f"""{_BOOK}, mid AS (SELECT symbol, epoch, t, (max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2 AS mid FROM bk GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, epoch, t, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS rank FROM bk)
 SELECT symbol, epoch, t, side, round(sum(CASE WHEN abs(price - mid) <= mid * CAST(0.005 AS DOUBLE) + CAST(1e-9 AS DOUBLE) THEN price * size ELSE 0 END), 7) AS notional, round(sum(CASE WHEN rank <= 5 THEN size END), 5) AS qty5
 FROM rk JOIN mid USING (symbol, epoch, t) GROUP BY symbol, epoch, t, side"""


def _walk_sql(target: str, by: str) -> str:
    unit = "size" if by == "qty" else "price * size"
    return f"""{_BOOK}, mid AS (SELECT symbol, epoch, t, (max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2 AS mid FROM bk GROUP BY ALL),
 c AS (SELECT *, sum({unit}) OVER w - {unit} AS before, row_number() OVER w AS rank FROM bk WINDOW w AS (PARTITION BY symbol, epoch, t, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, greatest(0, least({unit}, {target} - before)) / {'1' if by == 'qty' else 'price'} AS take FROM c),
 s AS (SELECT symbol, epoch, t, CASE WHEN side = 'ask' THEN 'buy' ELSE 'sell' END AS taker, sum(take) AS qty, sum(take * price) AS notional, count(*) FILTER (take > 0) AS n_levels,
  CASE WHEN side = 'ask' THEN max(price) FILTER (take > 0) ELSE min(price) FILTER (take > 0) END AS worst, sum({unit}) >= {target} - 1e-6 AS complete FROM k GROUP BY symbol, epoch, t, side)
 SELECT symbol, epoch, t, taker, round(qty, 5) AS qty, round(notional, 7) AS notional, round(notional / qty, 6) AS vwap, worst, n_levels, complete,
 round(CASE WHEN complete THEN (notional / qty / mid - 1) * 1e4 * (CASE WHEN taker = 'buy' THEN 1 ELSE -1 END) END, 4) AS impact_bps FROM s JOIN mid USING (symbol, epoch, t)"""


def _walked(spark: SparkSession, sf_dir: str, by: str, target: float) -> DataFrame:
    b = _book(spark, sf_dir)
    mids = book.top(b).select("symbol", "epoch", "t", ((F.col("bid_px") + F.col("ask_px")) / 2).alias("mid"))
    w = book.walk(b, ["symbol", "epoch", "t"], by, target).join(mids, ["symbol", "epoch", "t"])
    return w.select("symbol", "epoch", "t", "taker", F.round("qty", 5).alias("qty"), F.round("notional", 7).alias("notional"), R6("vwap").alias("vwap"), "worst", "n_levels", "complete", F.round(book.impact_bps("vwap", "mid", "taker", "complete"), 4).alias("impact_bps"))


def book_walk_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executable price of a quantity."""
    return _walked(spark, sf_dir, "qty", 500.0)


def book_walk_notional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executable price of a notional."""
    return _walked(spark, sf_dir, "notional", 50000.0)


def hash_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency draws of decisions: the same for both sides, another for each exit."""
    g = grid(quotes(spark, sf_dir), HOUR)
    return g.select("symbol", "ts_ns", *[F.round(uniform("7", F.col("symbol"), F.col("ts_ns"), leg), 9).alias(f"u_{leg}") for leg in ("entry", "exit")])


UNIFORM = f"""WITH {QUOTES}, {GRID} SELECT symbol, ts_ns, """ + ", ".join(
    f"round(CAST(CAST(concat('0x', substr(md5(concat_ws('|', '7', symbol, CAST(ts_ns AS VARCHAR), '{leg}')), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296, 9) AS u_{leg}" for leg in ("entry", "exit")) + " FROM grid"


def entry_exit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips at the touch after a latency and a horizon of six hours, net of fees and slippage."""
    g = grid(quotes(spark, sf_dir), HOUR).withColumn("mid_t", F.col("ts_ns"))
    q = quotes(spark, sf_dir).where("venue = 'lit'").select("symbol", "ts_local_ns", "event_id", "bid_px", "ask_px")
    g = g.withColumn("t_in", F.col("ts_ns") + F.floor(uniform("7", F.col("symbol"), F.col("ts_ns"), "entry") * 1_000_000_000)).withColumn("t_out", F.col("t_in") + 6 * HOUR)
    ends = g.drop("mid_t").select("symbol", "ts_ns", F.explode(F.array(F.struct(F.lit("in").alias("leg"), F.col("t_in").alias("t")), F.struct(F.lit("out").alias("leg"), F.col("t_out").alias("t")))).alias("e")).select("symbol", "ts_ns", "e.leg", "e.t")
    got = asof_join(ends, q, ["symbol"], "t", "ts_local_ns", ["bid_px", "ask_px"], DAY, "event_id")
    at = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    b = got.groupBy("symbol", "ts_ns").agg(*[at(leg, f"{c}_px").alias(f"{c}_{leg}") for leg in ("in", "out") for c in ("bid", "ask")], at("in", "t").alias("t_in"), at("out", "t").alias("t_out"))
    fee = 0.0004
    net = lambda side, px_in, px_out: side * (F.col(px_out) - F.col(px_in)) / F.col(px_in) - fee * (F.col(px_in) + F.col(px_out)) / F.col(px_in)
    return b.select("symbol", "ts_ns", F.round(net(1, "ask_in", "bid_out"), 8).alias("net_long"), F.round(net(-1, "bid_in", "ask_out"), 8).alias("net_short"), ((F.col("t_out") - F.col("t_in")) / 1e6).alias("hold_ms"))


_U = "floor(CAST(CAST(concat('0x', substr(md5(concat_ws('|', '7', symbol, CAST(ts_ns AS VARCHAR), 'entry')), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296 * 1000000000)"
LABELS = f"""WITH {QUOTES}, {GRID}, t AS (SELECT symbol, ts_ns, ts_ns + CAST({_U} AS BIGINT) AS t_in FROM grid),
 l AS (SELECT symbol, ts_local_ns, max_by(bid_px, event_id) AS bid_px, max_by(ask_px, event_id) AS ask_px FROM quotes WHERE venue = 'lit' GROUP BY ALL),
 j AS (SELECT t.symbol, t.ts_ns, a.bid_px AS bid_in, a.ask_px AS ask_in, b.bid_px AS bid_out, b.ask_px AS ask_out FROM (SELECT *, t_in + 6 * {HOUR} AS t_out FROM t) t
 ASOF LEFT JOIN l a ON t.symbol = a.symbol AND t.t_in >= a.ts_local_ns ASOF LEFT JOIN l b ON t.symbol = b.symbol AND t.t_out >= b.ts_local_ns)
 SELECT symbol, ts_ns, round((bid_out - ask_in) / ask_in - CAST(0.0004 AS DOUBLE) * (ask_in + bid_out) / ask_in, 8) AS net_long, round(-(ask_out - bid_in) / bid_in - CAST(0.0004 AS DOUBLE) * (bid_in + ask_out) / bid_in, 8) AS net_short,
 CAST(6 * {HOUR} AS DOUBLE) / 1e6 AS hold_ms FROM j"""

QUERIES = {
    "lead_lag_features": (lead_lag_features, f"WITH {MIDS} {LEAD_LAG}"),
    "lead_lag_summary": (lead_lag_summary, f"WITH {MIDS}, f AS ({LEAD_LAG}) SELECT symbol, count(*) AS n, round(avg(CAST(valid AS INTEGER)), 6) AS valid_share, round(corr(xret_1, nxt), 6) AS corr_next FROM (SELECT *, lead(lit_ret_1) OVER (PARTITION BY symbol ORDER BY ts_ns) AS nxt FROM f) GROUP BY symbol"),
    "asof_grid_state": (asof_grid_state, f"WITH {MIDS} SELECT symbol, ts_ns, round(lit_mid, 6) AS lit_mid, round(ref_mid, 6) AS ref_mid, lit_ts, ref_ts FROM mids"),
    "prefix_sum_flow": (prefix_sum_flow, PREFIX),
    "window_marks": (window_marks, MARKS),
    "ewma_mean": (ewma_mean, f"WITH {_NUMBERED} SELECT event_id, round(mean, 6) AS mean FROM e"),
    "ewma_var": (ewma_var, f"WITH {_NUMBERED} SELECT event_id, round(var, 6) AS var FROM v"),
    "basis_z": (basis_z, BASIS_Z),
    "rolling_median_delay": (rolling_median_delay, ROLLING),
    "obi": (obi, OBI),
    "ofi_cumulative": (ofi_cumulative, OFI),
    "vol_trend": (vol_trend, VOL),
    "lag_columns": (lag_columns, LAGS),
    "pair_correlation": (pair_correlation, PAIRS),
    "level_intervals": (level_intervals, f"WITH {INTERVALS} SELECT * FROM iv"),
    "book_asof_top": (book_asof_top, TOP),
    "book_depth_band": (book_depth_band, BAND),
    "book_walk_qty": (book_walk_qty, _walk_sql("500.0", "qty")),
    "book_walk_notional": (book_walk_notional, _walk_sql("50000.0", "notional")),
    "hash_uniform": (hash_uniform, UNIFORM),
    "entry_exit_labels": (entry_exit_labels, LABELS),
}
