"""Queries over grid features of two venues and over books told by messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scans import asof_scan, ewma, lagged, prefix_scan, rolling
from ..operators import book
from ..sources.tables import written
from ..sources.views import DAY, GRID, HOUR, LEVELS, TAPE, grid, levels, quotes, tape
from .market import _INSTANTS, _OFI, ALPHA, INTERVALS, NO_VARIANCE, WEEK, _instants, ewma_variance, level_intervals, with_flow

EPS = 1e-12
#: Grid rows that returns and flows look back; the longest return is also the trend's.
RETURNS, FLOWS = (1, 2, 6, 24), (1, 6, 24)
SECONDS = HOUR // 1_000_000_000
FAST, SLOW = 1 - 0.5 ** (1 / 24), 1 - 0.5 ** (1 / 96)
LATENCIES = 500
FUNDING_EVERY = 8 * HOUR
STALE = 6 * HOUR
R6 = lambda c: F.round(c, 6)
VENUES = ("lit", "ref")
CARRIED = ("lit_buy", "lit_sell", "lit_trades", "lit_ofi", "ref_buy", "ref_sell", "ref_ofi")
MONTHS = 30 * DAY


def grid_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of both venues as of each grid row, in one scan (B15-B17): touch, cumulated flow, funding, last times, latency."""
    q = written(with_flow(quotes(spark, sf_dir)))
    trade = F.col("event_type") == "purchase"
    buys = F.expr("event_id DIV 2") % 2 == 0
    lag_ms = (F.col("ts_local_ns") - F.col("ts_exch_ns")) / 1e6
    done = rolling(
        q.where(trade & (F.col("venue") == "lit")).withColumn("ms", lag_ms), ["symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY), LATENCIES,
        {"median": lambda w: F.percentile("ms", F.lit(0.5)).over(w.rowsBetween(1 - LATENCIES, 0))})
    q = q.unionByName(done.select("symbol", "event_id", "ts_local_ns", F.lit("exec").alias("venue"), F.col("median").alias("value")), allowMissingColumns=True)
    specs = {"latency": ("last", F.when(F.col("venue") == "exec", F.col("value")))}
    for v in VENUES:
        here = lambda x, v=v: F.when(F.col("venue") == v, x)
        touch = F.struct("bid_px", "bid_sz", "ask_px", "ask_sz", "ofi", F.col("ts_local_ns").alias("ts"))
        specs |= {
            f"{v}": ("last", here(touch)), f"{v}_buy": ("sum", here(F.when(trade & buys, F.col("ask_sz")))), f"{v}_sell": ("sum", here(F.when(trade & ~buys, F.col("ask_sz")))),
            f"{v}_trades": ("count", here(F.when(trade, 1))), f"{v}_trade_ts": ("last", here(F.when(trade, F.col("ts_local_ns")))),
            f"{v}_rate": ("last", here(F.when(F.col("event_type") == "click", F.struct((F.col("value") / 1e6).alias("rate"), F.col("ts_local_ns").alias("ts")))))}
    s = asof_scan(grid(quotes(spark, sf_dir), HOUR), written(q), ["symbol"], "ts_ns", "ts_local_ns", specs, DAY, "event_id")
    sides = [F.col(f"{v}.{c}").alias(f"{v}_{c}") for v in VENUES for c in ("bid_px", "bid_sz", "ask_px", "ask_sz", "ofi", "ts")]
    flows = [c for v in VENUES for c in (f"{v}_buy", f"{v}_sell", f"{v}_trades", f"{v}_trade_ts")]
    return s.select("symbol", "ts_ns", "latency", *sides, *flows, *[((F.col(f"{v}.bid_px") + F.col(f"{v}.ask_px")) / 2).alias(f"{v}_mid") for v in VENUES],
                    *[F.col(f"{v}_rate.rate").alias(f"{v}_funding") for v in VENUES], F.col("lit_rate.ts").alias("lit_funding_ts"))


_STATE = f"""WITH {_OFI}, {GRID}, cs AS (SELECT symbol, venue, ts_local_ns, event_id, bid_px, bid_sz, ask_px, ask_sz, ofi,
  coalesce(sum(CASE WHEN event_type = 'purchase' AND event_id // 2 % 2 = 0 THEN ask_sz END) OVER w, 0) AS buy, coalesce(sum(CASE WHEN event_type = 'purchase' AND event_id // 2 % 2 = 1 THEN ask_sz END) OVER w, 0) AS sell,
  count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER w AS trades, last_value(CASE WHEN event_type = 'purchase' THEN ts_local_ns END IGNORE NULLS) OVER w AS trade_ts,
  last_value(CASE WHEN event_type = 'click' THEN value / 1e6 END IGNORE NULLS) OVER w AS funding, last_value(CASE WHEN event_type = 'click' THEN ts_local_ns END IGNORE NULLS) OVER w AS funding_ts
  FROM fl WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id ROWS UNBOUNDED PRECEDING)),
 cu AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY venue, symbol, ts_local_ns ORDER BY event_id DESC) = 1),
 xl AS (SELECT symbol, ts_local_ns, quantile_cont((ts_local_ns - ts_exch_ns) / 1e6, 0.5) OVER (PARTITION BY symbol ORDER BY ts_local_ns, event_id ROWS {LATENCIES - 1} PRECEDING) AS med, event_id FROM quotes WHERE venue = 'lit' AND event_type = 'purchase'),
 xu AS (SELECT * FROM xl QUALIFY row_number() OVER (PARTITION BY symbol, ts_local_ns ORDER BY event_id DESC) = 1),
 st AS (SELECT g.symbol, g.ts_ns, x.med AS latency, """ + ", ".join(
    [f"{a}.{c} AS {v}_{c}" for v, a in (("lit", "l"), ("ref", "r")) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz", "trade_ts", "funding")]
    + [f"coalesce({a}.{c}, 0) AS {v}_{c}" for v, a in (("lit", "l"), ("ref", "r")) for c in ("buy", "sell", "trades")]
    + [f"{a}.ofi AS {v}_ofi, {a}.ts_local_ns AS {v}_ts, ({a}.bid_px + {a}.ask_px) / 2 AS {v}_mid" for v, a in (("lit", "l"), ("ref", "r"))]) + """, l.funding_ts AS lit_funding_ts
 FROM grid g ASOF LEFT JOIN (SELECT * FROM cu WHERE venue = 'lit') l ON g.symbol = l.symbol AND g.ts_ns >= l.ts_local_ns ASOF LEFT JOIN (SELECT * FROM cu WHERE venue = 'ref') r ON g.symbol = r.symbol AND g.ts_ns >= r.ts_local_ns
 ASOF LEFT JOIN xu x ON g.symbol = x.symbol AND g.ts_ns >= x.ts_local_ns)"""

#: Averages along the grid: name -> (value, alpha); values look at columns of the state and of the row before.
AVERAGES = {
    "rv_l": ("pow(ln(lit_mid / lit_mid_b1), 2)", FAST), "rv_r": ("pow(ln(ref_mid / ref_mid_b1), 2)", FAST), "rv_long": ("pow(ln(ref_mid / ref_mid_b1), 2)", SLOW),
    "rate": ("CAST(lit_trades - lit_trades_b1 AS DOUBLE)", SLOW), "spread": ("(lit_ask_px - lit_bid_px) / lit_mid * 1e4", SLOW),
    "depth_l": ("(lit_bid_sz + lit_ask_sz) / 2", SLOW), "depth_r": ("(ref_bid_sz + ref_ask_sz) / 2", SLOW)}


def grid_averages(state: DataFrame) -> DataFrame:
    """symbol, ts_ns, and for each of AVERAGES its mean, the mean before the row and the number of values: all series in one scan."""
    pairs = ", ".join(f"'{k}', {v}" for k, (v, _) in AVERAGES.items())
    long = state.select("symbol", "ts_ns", F.expr(f"stack({len(AVERAGES)}, {pairs}) AS (series, x)"))
    alpha = F.create_map(*[F.lit(y) for k, (_, a) in AVERAGES.items() for y in (k, a)])[F.col("series")]
    keys, order, bucket = ["symbol", "series"], ["ts_ns"], F.floor(F.col("ts_ns") / MONTHS)
    m = written(ewma(long, keys, order, bucket, alpha, "x", "mean", count="n", bounds=(min(SLOW, FAST), max(SLOW, FAST))))
    m = prefix_scan(m, keys, order, bucket, {"before": ("last<", F.col("mean"))})
    pick = lambda k, c: F.max(F.when(F.col("series") == k, F.col(c))).alias(f"{k}_{c}")
    return m.groupBy("symbol", "ts_ns").agg(*[pick(k, c) for k in AVERAGES for c in ("mean", "before", "n")])


def grid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and context of each grid row that touch, trades and funding tell."""
    s = grid_state(spark, sf_dir)
    mids = {f"{v}_mid_b{k}": (f"{v}_mid", k) for v in VENUES for k in RETURNS}
    flows = {f"{c}_b{k}": (c, k) for c in CARRIED for k in FLOWS}
    s = s.withColumn("at", F.col("ts_ns"))
    s = lagged(s, ["symbol"], "ts_ns", HOUR, mids | flows | {f"at_b{k}": ("at", k) for k in sorted({*RETURNS, *FLOWS})})
    s = s.withColumn("basis", F.log(F.col("lit_mid") / F.col("ref_mid")) * 1e4)
    s = written(s)
    bucket = F.floor(F.col("ts_ns") / MONTHS)
    z = ewma_variance(s.select("symbol", "ts_ns", "basis"), ["symbol"], ["ts_ns"], bucket, ALPHA, "basis", "z")
    z = prefix_scan(z, ["symbol"], ["ts_ns"], bucket, {"var_before": ("last<", F.col("z_var"))}).select("symbol", "ts_ns", "z_n", "z_dev", "var_before")
    s = s.join(grid_averages(s), ["symbol", "ts_ns"]).join(z, ["symbol", "ts_ns"])
    return s.selectExpr(*FEATURES)


def _feature(name: str, text: str, digits: int = 6) -> str:
    return f"round({text}, {digits}) AS {name}"


def _ret(v: str, k: int) -> str:
    return f"ln({v}_mid / {v}_mid_b{k}) * 1e4"


def _since(c: str, k: int) -> str:
    return f"({c} - {c}_b{k})"


def _aggr(v: str, k: int) -> str:
    b, s = _since(f"{v}_buy", k), _since(f"{v}_sell", k)
    return f"CASE WHEN at_b{k} IS NULL THEN NULL WHEN {b} + {s} > 0 THEN ({b} - {s}) / ({b} + {s}) ELSE 0 END"


_VOL = {n: f"CASE WHEN {n}_n > 1 THEN sqrt({n}_mean / {SECONDS}) * 1e4 END" for n in ("rv_l", "rv_r", "rv_long")}
_FRESH = {v: f"(ts_ns - {v}_ts) / 1e6" for v in VENUES}
_OK = {v: f"coalesce({v}_bid_px < {v}_ask_px, false)" for v in VENUES}
_FRESH_OK = f"coalesce(ts_ns - lit_ts <= {STALE} AND ts_ns - ref_ts <= {STALE}, false)"
#: Columns of ``grid_features``, in words that both engines read.
FEATURES = [
    "symbol", "ts_ns",
    *[_feature(f"{v}_ret_{k}", _ret(v, k)) for k in RETURNS for v in VENUES], *[_feature(f"xret_{k}", f"{_ret('ref', k)} - {_ret('lit', k)}") for k in RETURNS],
    _feature("basis_bps", "basis"), _feature("basis_z", f"CASE WHEN z_n > 20 AND var_before > CAST({NO_VARIANCE} AS DOUBLE) THEN z_dev / sqrt(var_before) END", 5),
    *[_feature(f"{v}_obi_l1", f"({v}_bid_sz - {v}_ask_sz) / ({v}_bid_sz + {v}_ask_sz + CAST({EPS} AS DOUBLE))") for v in VENUES],
    *[_feature(f"{v}_ofi_{k}", f"{_since(f'{v}_ofi', k)} / (depth_{v[0]}_mean + CAST({EPS} AS DOUBLE))") for k in FLOWS for v in VENUES],
    *[_feature(f"{v}_aggr_{k}", _aggr(v, k)) for k in FLOWS for v in VENUES],
    *[_feature(f"lit_trade_rate_{k}", f"{_since('lit_trades', k)} / CAST({k * SECONDS} AS DOUBLE)", 9) for k in FLOWS],
    *[_feature(f"{v}_spread_bps", f"({v}_ask_px - {v}_bid_px) / {v}_mid * 1e4") for v in VENUES],
    _feature("lit_rv_bps", _VOL["rv_l"]), _feature("ref_rv_bps", _VOL["rv_r"]), _feature("vol_ratio", f"({_VOL['rv_r']}) / nullif({_VOL['rv_long']}, 0)"),
    _feature("trend", f"CASE WHEN rv_r_mean > 0 THEN {_ret('ref', RETURNS[-1])} / (({_VOL['rv_r']}) * sqrt(CAST({RETURNS[-1] * SECONDS} AS DOUBLE))) END"),
    *[_feature(f"{v}_funding", f"{v}_funding * 1e4") for v in VENUES], _feature("funding_diff", "(lit_funding - ref_funding) * 1e4"),
    _feature("lit_funding_eta_s", f"((floor(lit_funding_ts / CAST({FUNDING_EVERY} AS DOUBLE)) + 1) * {FUNDING_EVERY} - ts_ns) / 1e9", 3),
    _feature("spread_ratio", "CASE WHEN spread_n - (CASE WHEN lit_mid IS NULL THEN 0 ELSE 1 END) > 20 AND spread_before > 0 THEN (lit_ask_px - lit_bid_px) / lit_mid * 1e4 / spread_before END"),
    _feature("trade_rate_ratio", f"CASE WHEN rate_n > 20 AND rate_mean > 0 THEN {_since('lit_trades', FLOWS[0])} / CAST({FLOWS[0]} AS DOUBLE) / rate_mean END"),
    *[_feature(f"{v}_fresh_ms", _FRESH[v]) for v in VENUES], _feature("fresh_diff_ms", f"{_FRESH['lit']} - {_FRESH['ref']}"),
    _feature("trade_age_ms", "(ts_ns - lit_trade_ts) / 1e6"), _feature("exec_latency_ms", "coalesce(latency, CAST(400 AS DOUBLE))", 4),
    *[f"{_OK[v]} AS {v}_usable" for v in VENUES], f"{_FRESH_OK} AS fresh_ok", _feature("lit_mid", "lit_mid"), _feature("ref_mid", "ref_mid"), "lit_bid_px AS lit_bid", "lit_ask_px AS lit_ask",
    f"{_OK['lit']} AND {_OK['ref']} AND {_FRESH_OK} AND at_b{RETURNS[-1]} IS NOT NULL AS valid"]


def _average_sql(name: str, value: str, alpha: float) -> str:
    """CTEs with the mean, the mean before and the count of one series."""
    keep = 1 - alpha
    return (
        f"{name}_v AS (SELECT symbol, ts_ns, {value} AS x FROM lg), {name}_i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) - 1 AS i FROM {name}_v WHERE x IS NOT NULL),"
        f" {name}_m AS (SELECT symbol, ts_ns, i + 1 AS n, pow({keep!r}, i) * sum((CASE WHEN i = 0 THEN 1 ELSE {alpha!r} END) * x * pow({keep!r}, -i)) OVER (PARTITION BY symbol ORDER BY i) AS mean FROM {name}_i),"
        f" {name}_a AS (SELECT v.symbol, v.ts_ns, last_value(m.mean IGNORE NULLS) OVER w AS {name}_mean, last_value(m.mean IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {name}_before, coalesce(last_value(m.n IGNORE NULLS) OVER w, 0) AS {name}_n"
        f" FROM {name}_v v LEFT JOIN {name}_m m ON v.symbol = m.symbol AND v.ts_ns = m.ts_ns WINDOW w AS (PARTITION BY v.symbol ORDER BY v.ts_ns))")


_LAGGED = ", ".join(
    [f"lag({v}_mid, {k}) OVER w AS {v}_mid_b{k}" for v in VENUES for k in RETURNS] + [f"lag({c}, {k}) OVER w AS {c}_b{k}" for c in CARRIED for k in FLOWS] + [f"lag(ts_ns, {k}) OVER w AS at_b{k}" for k in sorted({*RETURNS, *FLOWS})])
_Z = f"""zi AS (SELECT symbol, ts_ns, basis AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) - 1 AS i FROM lg WHERE basis IS NOT NULL),
 zm AS (SELECT *, pow({1 - ALPHA}, i) * sum((CASE WHEN i = 0 THEN 1 ELSE {ALPHA} END) * x * pow({1 - ALPHA}, -i)) OVER (PARTITION BY symbol ORDER BY i) AS mean FROM zi), zd AS (SELECT *, x - lag(mean) OVER (PARTITION BY symbol ORDER BY i) AS z_dev FROM zm),
 zv AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE pow({1 - ALPHA}, i) * sum({ALPHA} * z_dev * z_dev * {1 - ALPHA} * pow({1 - ALPHA}, -i)) OVER (PARTITION BY symbol ORDER BY i) END AS var FROM zd), za AS (SELECT symbol, ts_ns, i + 1 AS z_n, z_dev, lag(var) OVER (PARTITION BY symbol ORDER BY i) AS var_before FROM zv)"""
GRID_FEATURES = (
    f"{_STATE}, lg AS (SELECT *, ln(lit_mid / ref_mid) * 1e4 AS basis, {_LAGGED} FROM st WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns)), " + ", ".join(_average_sql(k, v, a) for k, (v, a) in AVERAGES.items())
    + f", {_Z} SELECT {', '.join(FEATURES).replace('symbol, ts_ns', 'lg.symbol, lg.ts_ns', 1)} FROM lg " + " ".join(f"JOIN {k}_a USING (symbol, ts_ns)" for k in AVERAGES) + " LEFT JOIN za USING (symbol, ts_ns)").replace("SELECT lg.symbol, lg.ts_ns", "SELECT symbol, ts_ns")


#: Share of the mid that a depth band reaches, levels of a side that count as depth, and the notional of the impact.
BAND, DEPTH, NOTIONAL = 0.005, 10, 50_000.0


def band_flow(changes: DataFrame, band: float, bucket_ns: int) -> DataFrame:
    """``changes`` of valid books that lie in the band around the mid just before them, with what they add and remove.

    Changes count one after another by (ts_local_ns, seq), those of one instant too: each meets the levels that the ones
    before it left, in buckets of time.
    """
    keys = ["symbol", "epoch"]
    w = Window.partitionBy(*keys, "side", "price").orderBy("ts_local_ns", "seq")  # one level of one epoch
    place = F.struct("ts_local_ns", "seq")
    each = changes.select(*keys, "side", "price", "size", "ts_local_ns", "seq", F.coalesce(F.lag("size").over(w), F.lit(0.0)).alias("old"), F.lead(place).over(w).alias("until"))
    last = changes.groupBy(*keys).agg(F.max(place).alias("last"))
    held = each.where("size > 0").join(last, keys).select(*keys, F.col("side").alias("s"), F.col("price").alias("p"), place.alias("since"), F.coalesce("until", "last").alias("until"))
    held = held.withColumn("b", F.explode(F.sequence(F.floor(F.col("since.ts_local_ns") / bucket_ns), F.floor(F.col("until.ts_local_ns") / bucket_ns))))
    at = each.select(*keys, place.alias("at"), F.floor(F.col("ts_local_ns") / bucket_ns).alias("b"))
    met = at.join(held, [*keys, "b"]).where("at > since and at <= until")
    mids = met.groupBy(*keys, "at").agg((F.max(F.when(F.col("s") == "bid", F.col("p"))) + F.min(F.when(F.col("s") == "ask", F.col("p")))).alias("twice"))
    mids = mids.where("twice is not null").select(*keys, "at.ts_local_ns", "at.seq", (F.col("twice") / 2).alias("mid"))
    each = each.join(mids, [*keys, "ts_local_ns", "seq"]).where((F.col("price") >= F.col("mid") * (1 - band)) & (F.col("price") <= F.col("mid") * (1 + band)))
    d = F.col("size") - F.col("old")
    return each.select(*keys, "ts_local_ns", "seq", F.greatest(d, F.lit(0.0)).alias("added"), F.greatest(-d, F.lit(0.0)).alias("removed"))


def band_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size added and removed inside the band around the mid before each change, by day."""
    flow = band_flow(levels(spark, sf_dir), BAND, WEEK)
    return flow.groupBy("symbol", F.floor(F.col("ts_local_ns") / DAY).alias("day")).agg(F.round(F.sum("added"), 5).alias("added"), F.round(F.sum("removed"), 5).alias("removed"))


_FLOW = f"""lv AS (SELECT *, coalesce(lag(size) OVER w, 0) AS old, lead(ts_local_ns) OVER w AS to_ts, lead(seq) OVER w AS to_seq FROM levels WINDOW w AS (PARTITION BY symbol, epoch, side, price ORDER BY ts_local_ns, seq)),
 bm AS (SELECT c.symbol, c.epoch, c.price, c.size, c.old, c.seq, c.ts_local_ns, (max(i.price) FILTER (i.side = 'bid') + min(i.price) FILTER (i.side = 'ask')) / 2 AS mid FROM lv c JOIN lv i ON c.symbol = i.symbol AND c.epoch = i.epoch AND i.size > 0
  AND (c.ts_local_ns > i.ts_local_ns OR (c.ts_local_ns = i.ts_local_ns AND c.seq > i.seq)) AND (i.to_ts IS NULL OR c.ts_local_ns < i.to_ts OR (c.ts_local_ns = i.to_ts AND c.seq <= i.to_seq)) GROUP BY ALL),
 bf AS (SELECT *, greatest(size - old, 0) AS added, greatest(old - size, 0) AS removed FROM bm WHERE price >= mid * (1 - CAST({BAND} AS DOUBLE)) AND price <= mid * (1 + CAST({BAND} AS DOUBLE)))"""
ADDED = f"WITH {INTERVALS}, {_FLOW} SELECT symbol, ts_local_ns // {DAY} AS day, round(sum(added), 5) AS added, round(sum(removed), 5) AS removed FROM bf GROUP BY 1, 2"


def book_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that the whole book tells at each midnight (G05, G09, G10, G12, G13): depth imbalance, band depth, impact, and how
    much of the band was cancelled and refilled over three spans."""
    iv = written(level_intervals(spark, sf_dir))
    instants = _instants(spark, sf_dir)
    b = written(book.book_at(iv, instants, WEEK))
    keys = ["symbol", "epoch", "t"]
    mid = book.top(b).select(*keys, ((F.col("bid_px") + F.col("ask_px")) / 2).alias("mid"))
    bid, near = F.col("side") == "bid", F.abs(F.col("price") - F.col("mid")) <= F.col("mid") * BAND + 1e-9
    deep = book.ranked(b).join(mid, keys).groupBy(*keys).agg(
        F.first("mid").alias("mid"), *[F.sum(F.when((F.col("side") == s) & (F.col("rank") <= DEPTH), F.col("size")).otherwise(0.0)).alias(f"qty_{s}") for s in ("bid", "ask")],
        *[F.sum(F.when((F.col("side") == s) & near, F.col("price") * F.col("size")).otherwise(0.0)).alias(f"band_{s}") for s in ("bid", "ask")], F.max(bid.cast("int")).alias("bids"), F.max((~bid).cast("int")).alias("asks"))
    deep = deep.where("bids = 1 and asks = 1").drop("bids", "asks")
    walked = book.walk(b, keys, "notional", NOTIONAL).join(mid, keys)
    impact = walked.groupBy(*keys).agg(*[F.max(F.when(F.col("taker") == s, book.impact_bps("vwap", "mid", "taker", "complete"))).alias(f"impact_{s}") for s in ("buy", "sell")])
    flow = band_flow(levels(spark, sf_dir), BAND, WEEK).select("symbol", F.col("ts_local_ns").alias("ts"), "seq", "added", "removed")
    # sizes are whole numbers and an instant counts as a whole: one row for each, whatever trades there are
    traded = tape(spark, sf_dir).where("venue = 'lit'").groupBy("symbol", F.col("ts_local_ns").alias("ts")).agg(F.sum("size").alias("traded"))
    moves = flow.unionByName(traded, allowMissingColumns=True)
    s = asof_scan(instants, written(moves), ["symbol"], "t", "ts", {c: ("sum", F.col(c)) for c in ("added", "removed", "traded")}, WEEK, "seq").join(deep, keys, "left").join(impact, keys, "left")
    s = written(s.withColumn("at", F.col("t")).withColumn("band", (F.col("band_bid") + F.col("band_ask")) / 2 / F.col("mid")))
    s = ewma(s, ["symbol"], ["t"], F.floor(F.col("t") / (360 * DAY)), SLOW, "band", "band_mean")
    s = lagged(s, ["symbol"], "t", DAY, {f"{c}_b{k}": (c, k) for c in ("added", "removed", "traded") for k in FLOWS})
    return s.selectExpr(*BOOK_FEATURES)


def _cancel(k: int) -> str:
    return f"greatest(CAST(0 AS DOUBLE), {_since('removed', k)} - {_since('traded', k)}) / (band_mean + CAST({EPS} AS DOUBLE))"


def _refill(k: int) -> str:
    r = _since("removed", k)
    return f"CASE WHEN {r} > CAST(1e-9 AS DOUBLE) THEN {_since('added', k)} / ({r} + CAST({EPS} AS DOUBLE)) END"


BOOK_FEATURES = [
    "symbol", "epoch", "t", _feature("obi_depth", f"(qty_bid - qty_ask) / (qty_bid + qty_ask + CAST({EPS} AS DOUBLE))"), *[_feature(f"depth_{s}_log", f"ln(1 + band_{s})") for s in ("bid", "ask")],
    *[_feature(f"impact_{s}_bps", f"impact_{s}", 4) for s in ("buy", "sell")], *[_feature(f"cancel_{k}", _cancel(k)) for k in FLOWS], *[_feature(f"replenish_{k}", _refill(k)) for k in FLOWS]]
_IMPACT = f"""ck AS (SELECT *, sum(price * size) OVER w - price * size AS before FROM bk WINDOW w AS (PARTITION BY symbol, epoch, t, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END ROWS UNBOUNDED PRECEDING)),
 tk AS (SELECT *, greatest(0, least(price * size, {NOTIONAL} - before)) / price AS take FROM ck), wk AS (SELECT symbol, epoch, t, side, sum(take * price) / sum(take) AS vwap, sum(price * size) >= {NOTIONAL} - 1e-6 AS complete FROM tk GROUP BY ALL)"""
_BOOK_LAGS = ", ".join(f"b{k}.{c} AS {c}_b{k}" for c in ("added", "removed", "traded") for k in FLOWS)
BOOK_SQL = f"""WITH {INTERVALS}, {_INSTANTS}, {TAPE}, {_FLOW}, mid AS (SELECT symbol, epoch, t, (max(price) FILTER (side = 'bid') + min(price) FILTER (side = 'ask')) / 2 AS mid FROM bk GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, epoch, t, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS rank FROM bk),
 dp AS (SELECT symbol, epoch, t, any_value(mid) AS mid, """ + ", ".join(f"sum(CASE WHEN side = '{s}' AND rank <= {DEPTH} THEN size ELSE 0 END) AS qty_{s}, sum(CASE WHEN side = '{s}' AND abs(price - mid) <= mid * CAST({BAND} AS DOUBLE) + CAST(1e-9 AS DOUBLE) THEN price * size ELSE 0 END) AS band_{s}" for s in ("bid", "ask")) + f"""
  FROM rk JOIN mid USING (symbol, epoch, t) GROUP BY symbol, epoch, t HAVING count(*) FILTER (side = 'bid') > 0 AND count(*) FILTER (side = 'ask') > 0), {_IMPACT},
 ip AS (SELECT symbol, epoch, t, max(CASE WHEN side = 'ask' AND complete THEN (vwap / mid - 1) * 1e4 END) AS impact_buy, max(CASE WHEN side = 'bid' AND complete THEN (vwap / mid - 1) * -1e4 END) AS impact_sell FROM wk JOIN mid USING (symbol, epoch, t) GROUP BY ALL),
 mv AS (SELECT symbol, ts_local_ns AS ts, sum(added) AS added, sum(removed) AS removed, 0 AS traded FROM bf GROUP BY ALL UNION ALL SELECT symbol, ts_local_ns, 0, 0, sum(size) FROM tape WHERE venue = 'lit' GROUP BY ALL), mg AS (SELECT symbol, ts, sum(added) AS added, sum(removed) AS removed, sum(traded) AS traded FROM mv GROUP BY ALL),
 mc AS (SELECT symbol, ts, sum(added) OVER w AS added, sum(removed) OVER w AS removed, sum(traded) OVER w AS traded FROM mg WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 s0 AS (SELECT i.symbol, i.epoch, i.t, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(traded, 0) AS traded FROM instants i ASOF LEFT JOIN mc ON i.symbol = mc.symbol AND i.t >= mc.ts),
 s1 AS (SELECT s0.*, qty_bid, qty_ask, band_bid, band_ask, impact_buy, impact_sell, (band_bid + band_ask) / 2 / dp.mid AS x FROM s0 LEFT JOIN dp USING (symbol, epoch, t) LEFT JOIN ip USING (symbol, epoch, t)),
 s2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, (row_number() OVER (PARTITION BY symbol ORDER BY t) - 1) // 400 AS g FROM s1 WHERE x IS NOT NULL),
 s3 AS (SELECT *, sum((CASE WHEN i = 0 THEN 1 ELSE {SLOW!r} END) * x * pow({1 - SLOW!r}, g * 400 - i)) OVER (PARTITION BY symbol, g ORDER BY i) AS part FROM s2), s4 AS (SELECT symbol, g, max_by(part, i) AS whole FROM s3 GROUP BY ALL),
 s5 AS (SELECT s3.symbol, s3.t, pow({1 - SLOW!r}, s3.i - s3.g * 400) * any_value(s3.part) + coalesce(sum(s4.whole * pow({1 - SLOW!r}, s3.i - s4.g * 400)), 0) AS band_mean FROM s3 LEFT JOIN s4 ON s3.symbol = s4.symbol AND s4.g < s3.g GROUP BY s3.symbol, s3.t, s3.i, s3.g),
 s6 AS (SELECT s1.*, last_value(band_mean IGNORE NULLS) OVER (PARTITION BY s1.symbol ORDER BY s1.t) AS band_mean FROM s1 LEFT JOIN s5 ON s1.symbol = s5.symbol AND s1.t = s5.t),
 lg AS (SELECT s6.*, {_BOOK_LAGS} FROM s6 {" ".join(f"LEFT JOIN s0 b{k} ON b{k}.symbol = s6.symbol AND b{k}.t = s6.t - {k * DAY}" for k in FLOWS)}) SELECT {", ".join(BOOK_FEATURES)} FROM lg"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's level changes of a symbol as one message: snapshots every 45th day, disconnects every 50th, deltas else."""
    day = F.floor(F.col("ts_local_ns") / DAY)
    level = F.struct("seq", "price", "size")
    m = levels(spark, sf_dir).groupBy("symbol", day.alias("day")).agg(
        F.max("ts_local_ns").alias("ts_local_ns"), F.max("seq").alias("seq"), *[F.sort_array(F.collect_list(F.when(F.col("side") == s, level))).alias(f"{s}s") for s in ("bid", "ask")])
    kind = F.when(F.col("day") % 45 == 0, "snapshot").when(F.col("day") % 50 == 0, "gap").otherwise("delta")
    # the last change of a price in a message stands, as absolute sizes overwrite each other
    plain = lambda c: F.transform(F.filter(c, lambda x: ~F.exists(c, lambda y: (y["price"] == x["price"]) & (y["seq"] > x["seq"]))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    return m.select("symbol", "ts_local_ns", "seq", kind.alias("kind"), plain(F.col("bids")).alias("bids"), plain(F.col("asks")).alias("asks"))


def book_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of books rebuilt from snapshots and deltas, with the time in which each is in force."""
    changes, _ = book.message_levels(messages(spark, sf_dir), ["ts_local_ns", "seq"], F.floor(F.col("ts_local_ns") / WEEK))
    return book.level_intervals(changes).drop("seq")


def book_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in which a book is valid: from a snapshot to the next one or to a disconnect."""
    return book.message_levels(messages(spark, sf_dir), ["ts_local_ns", "seq"], F.floor(F.col("ts_local_ns") / WEEK))[1]


_MESSAGES = f"""{LEVELS}, dl AS (SELECT *, ts_local_ns // {DAY} AS day, max(ts_local_ns) OVER (PARTITION BY symbol, ts_local_ns // {DAY}) AS ts FROM levels),
 md AS (SELECT DISTINCT symbol, day, ts, CASE WHEN day % 45 = 0 THEN 'snapshot' WHEN day % 50 = 0 THEN 'gap' ELSE 'delta' END AS kind FROM dl),
 me AS (SELECT *, sum(CASE WHEN kind <> 'delta' THEN 1 ELSE 0 END) OVER w AS epoch, last_value(CASE WHEN kind <> 'delta' THEN kind END IGNORE NULLS) OVER w AS mode FROM md WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
 vd AS (SELECT symbol, epoch, ts AS valid_from, lead(ts) OVER (PARTITION BY symbol ORDER BY epoch) AS valid_to, kind FROM me WHERE kind <> 'delta')"""
REBUILT = f"""WITH {_MESSAGES}, ch AS (SELECT dl.symbol, me.epoch, dl.side, dl.price, max_by(dl.size, dl.seq) AS size, dl.ts FROM dl JOIN me ON dl.symbol = me.symbol AND dl.day = me.day WHERE me.mode = 'snapshot' GROUP BY ALL)
 SELECT symbol, epoch, side, price, size, ts AS valid_from, coalesce(nxt, valid_to) AS valid_to FROM (SELECT *, lead(ts) OVER (PARTITION BY symbol, epoch, side, price ORDER BY ts) AS nxt FROM ch) JOIN vd USING (symbol, epoch) WHERE size > 0"""


def book_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best levels of each midnight's book once a newer touch lies over it."""
    keys = ["symbol", "epoch", "t"]
    b = written(book.book_at(level_intervals(spark, sf_dir), _instants(spark, sf_dir), WEEK))
    touch = book.top(b).where("bid_px is not null and ask_px is not null").select(*keys, F.round(F.col("bid_px") - 0.1, 2).alias("bid_px"), F.lit(7.0).alias("bid_sz"), F.round(F.col("ask_px") + 0.05, 2).alias("ask_px"), (F.floor(F.col("t") / DAY) % 3).cast("double").alias("ask_sz"))
    o = book.overlay(b, touch, keys)
    return o.groupBy(*keys, "side").agg(F.count("*").alias("n"), F.round(F.sum("size"), 5).alias("qty"), F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask"))


OVERLAY = f"""WITH {INTERVALS}, {_INSTANTS}, tp AS (SELECT symbol, epoch, t, max(price) FILTER (side = 'bid') AS b, min(price) FILTER (side = 'ask') AS a FROM bk GROUP BY ALL),
 tc AS (SELECT symbol, epoch, t, round(b - CAST(0.1 AS DOUBLE), 2) AS b, round(a + CAST(0.05 AS DOUBLE), 2) AS a, CAST(t // {DAY} % 3 AS DOUBLE) AS az FROM tp WHERE a IS NOT NULL AND b IS NOT NULL),
 o AS (SELECT bk.symbol, bk.epoch, bk.t, side, price, size FROM bk LEFT JOIN tc USING (symbol, epoch, t) WHERE b IS NULL OR (side = 'bid' AND price < b) OR (side = 'ask' AND (price > a OR (price = a AND az <= 0)))
  UNION ALL SELECT symbol, epoch, t, 'bid', b, 7 FROM tc UNION ALL SELECT symbol, epoch, t, 'ask', a, az FROM tc WHERE az > 0)
 SELECT symbol, epoch, t, side, count(*) AS n, round(sum(size), 5) AS qty, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask FROM o GROUP BY symbol, epoch, t, side"""

QUERIES = {
    "grid_features": (grid_features, GRID_FEATURES),
    "band_added_removed": (band_added_removed, ADDED),
    "book_features": (book_features, BOOK_SQL),
    "book_rebuilt": (book_rebuilt, REBUILT),
    "book_validity": (book_validity, f"WITH {_MESSAGES} SELECT symbol, epoch, valid_from, valid_to FROM vd WHERE kind = 'snapshot'"),
    "book_overlay": (book_overlay, OVERLAY),
}
