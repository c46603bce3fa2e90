"""Queries over executed trades, equity, labels by book walk, policies, champions and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scans import asof_join, asof_scan, prefix_scan, uniform
from ..operators import book, outcomes, risk, stats
from ..sources import reports
from ..sources.tables import shared_path, written
from ..sources.views import DAY, HOUR, QUOTES, quotes, table, tape
from .feeds import data_span
from .labels import _ENTRIES, PASSIVE, passive_fill
from .market import _INSTANTS, INTERVALS, WEEK, _instants, level_intervals
from .research import _DRAW, MONTH_NS, R, THRESHOLDS, beyond_thresholds, deflated_sharpe, exec_latency_match, spa

REPS = 100
NOTIONAL, TAKER, MAKER, HOLD = 50_000.0, 0.0004, 0.0002, 7 * DAY
INITIAL = 1e8


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed trades, from ``lineitem``: what a trade row of the evaluation holds."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_returnflag").alias("model"), F.when(c("l_linenumber") % 3 == 0, "passive").otherwise("aggressive").alias("exec_mode"), (F.unix_micros(c("l_shipdate").cast("timestamp")) * 1000).alias("t_entry"),
        ((c("l_discount") - 0.05) + (c("l_tax") - 0.04) / 10 + F.when(c("l_returnflag") == "A", 0.004).when(c("l_returnflag") == "N", 0.0035).otherwise(-0.001)).alias("ret"), F.lit(0.0004).alias("fees"), ((c("l_linenumber") - 4) / 1e5).alias("funding"),
        (c("l_quantity") % 5).alias("slip_bps"), (-c("l_discount") / 10).alias("mae"), (c("l_quantity") + 40).alias("lat_ms"), c("l_extendedprice").alias("notional"), (c("l_discount") - 0.05).alias("mu"))


_D = lambda x: f"CAST({x} AS DOUBLE)"
TRADES = f"""tr AS (SELECT l_orderkey, l_linenumber, l_returnflag AS model, CASE WHEN l_linenumber % 3 = 0 THEN 'passive' ELSE 'aggressive' END AS exec_mode, epoch_us(l_shipdate) * 1000 AS t_entry,
 (l_discount - {_D(0.05)}) + (l_tax - {_D(0.04)}) / 10 + CASE l_returnflag WHEN 'A' THEN {_D(0.004)} WHEN 'N' THEN {_D(0.0035)} ELSE {_D(-0.001)} END AS ret, {_D(0.0004)} AS fees, (l_linenumber - 4) / 1e5 AS funding, l_quantity % 5 AS slip_bps, -l_discount / 10 AS mae, l_quantity + 40 AS lat_ms,
 l_extendedprice AS notional, l_discount - {_D(0.05)} AS mu FROM lineitem)"""
BY = ["model", "exec_mode"]
_GAIN, _LOSS = "sum(greatest(ret, 0))", "sum(greatest(-ret, 0))"
_AGGREGATES = {
    "n_trades": ("count(1)", None), "mean_net": ("avg(ret)", 8), "median_net": ("median(ret)", 8), "hit_rate": ("avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END)", 4), "mean_gross": ("avg(ret + fees - funding)", 8), "mean_fees": ("avg(fees)", 8),
    "mean_funding": ("avg(funding)", 9), "mean_slip_bps": ("avg(slip_bps)", 5), "mean_mae": ("avg(mae)", 7), "profit_factor": (f"CASE WHEN {_LOSS} > 0 THEN round({_GAIN} / {_LOSS}, 6) WHEN {_GAIN} > 0 THEN CAST('Infinity' AS DOUBLE) END", None), "expectancy": ("avg(ret * notional)", 4),
    "worst": ("min(ret)", 8), "best": ("max(ret)", 8), "mean_predicted": ("avg(mu)", 8)}
_QUANTILES = {"slip_p90_bps": ("slip_bps", 0.9, 4), "latency_p50_ms": ("lat_ms", 0.5, 4), "latency_p90_ms": ("lat_ms", 0.9, 4)}
_NAMES = [*_AGGREGATES, *_QUANTILES]


def metrics(t: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of each group of trades that one aggregation gives."""
    aggs = [F.expr(e if d is None else f"round({e}, {d})").alias(k) for k, (e, d) in _AGGREGATES.items()]
    return t.groupBy(*by).agg(*aggs, *[F.round(F.percentile(c, F.lit(q)), d).alias(k) for k, (c, q, d) in _QUANTILES.items()])


def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of executed trades by model and execution."""
    t = trades(spark, sf_dir).withColumn("block", F.floor(F.col("t_entry") / MONTH_NS))
    se = stats.cluster_se(t, BY, "ret", "block").select(*BY, F.col("clusters").alias("n_blocks"), R("se", 8).alias("cluster_se"))
    ci = stats.cluster_bootstrap(t, BY, "ret", "block", REPS, 0.9, "21").select(*BY, R("lo", 8).alias("ci_lo"), R("hi", 8).alias("ci_hi"))
    es = stats.expected_shortfall(t, BY, "ret", 0.05).select(*BY, R("es", 8).alias("es95"))
    share = t.groupBy("model").agg(R(F.avg((F.col("exec_mode") == "passive").cast("int")), 4).alias("passive_share"))
    return metrics(t, BY).join(se, BY).join(ci, BY).join(es, BY).join(share, "model")


def _boot_sql(by: str, seed: str, source: str = "tr", value: str = "ret") -> str:
    parts = ", ".join(f"'{seed}'" if i == 0 else x for i, x in enumerate(["", *by.split(", "), "CAST(rep AS VARCHAR)", "CAST(i AS VARCHAR)"]))
    return f"""bh AS (SELECT {by}, t_entry // {MONTH_NS} AS block, sum({value}) AS s, count(*) AS n FROM {source} GROUP BY ALL), bc AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS g FROM bh),
 bd AS (SELECT {by}, rep, CAST(floor({_DRAW.format(parts=parts)} * g) AS BIGINT) AS i FROM bc, (SELECT unnest(range(1, {REPS + 1})) AS rep)), bm AS (SELECT {by}, rep, sum(s) / sum(n) AS m FROM bd JOIN bc USING ({by}, i) GROUP BY {by}, rep),
 ci AS (SELECT {by}, quantile_cont(m, 0.05) AS lo, quantile_cont(m, 0.95) AS hi FROM bm GROUP BY {by}),
 bx AS (SELECT *, sum(s) OVER (PARTITION BY {by}) / sum(n) OVER (PARTITION BY {by}) AS mean FROM bh), se AS (SELECT {by}, count(*) AS n_blocks, sqrt(sum(pow(s - n * mean, 2)) * count(*) / (count(*) - 1)) / sum(n) AS se, any_value(mean) AS mean FROM bx GROUP BY {by})"""


_BY = ", ".join(BY)
METRICS = f"""WITH {TRADES}, {_boot_sql(_BY, '21')}, er AS (SELECT {_BY}, ret, row_number() OVER (PARTITION BY {_BY} ORDER BY ret) AS r, greatest(1, ceil(count(*) OVER (PARTITION BY {_BY}) * {_D(0.05)})) AS k FROM tr), es AS (SELECT {_BY}, avg(ret) AS es FROM er WHERE r <= k GROUP BY ALL),
 ps AS (SELECT model, round(avg(CASE WHEN exec_mode = 'passive' THEN 1 ELSE 0 END), 4) AS passive_share FROM tr GROUP BY model),
 mt AS (SELECT {_BY}, {", ".join(f"{e if d is None else f'round({e}, {d})'} AS {k}" for k, (e, d) in _AGGREGATES.items())}, {", ".join(f"round(quantile_cont({c}, {q}), {d}) AS {k}" for k, (c, q, d) in _QUANTILES.items())} FROM tr GROUP BY ALL)
 SELECT mt.*, n_blocks, round(se.se, 8) AS cluster_se, round(lo, 8) AS ci_lo, round(hi, 8) AS ci_hi, round(es, 8) AS es95, passive_share FROM mt JOIN se USING ({_BY}) JOIN ci USING ({_BY}) JOIN es USING ({_BY}) JOIN ps USING (model)"""


def equity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final equity, return, drawdowns, shortfall of monthly results and the worst equity inside a trade."""
    t = trades(spark, sf_dir).withColumn("pnl", F.col("ret") * F.col("notional")).withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    t = t.groupBy("model", "t_entry", "id").agg(F.min("notional").alias("notional"), F.min("mae").alias("mae"), F.sum("pnl").alias("pnl"))  # one row a trade
    bucket = F.floor(F.col("t_entry") / MONTH_NS)
    t = prefix_scan(t, ["model"], ["t_entry", "id"], bucket, {"before": ("sum<", F.col("pnl"))}).withColumn("before", F.col("before") + INITIAL).withColumn("after", F.col("before") + F.col("pnl"))
    t = prefix_scan(t, ["model"], ["t_entry", "id"], bucket, {"peak": ("max", F.col("after"))}).withColumn("peak", F.greatest("peak", F.lit(INITIAL)))
    fall = F.col("peak") - F.col("after")
    whole = t.groupBy("model").agg(
        R(F.max_by("after", F.struct("t_entry", "id")), 3).alias("final"), R(F.max_by("after", F.struct("t_entry", "id")) / INITIAL - 1, 8).alias("total_return"), R(F.max(fall), 3).alias("dd_abs"), R(F.max(fall / F.col("peak")), 8).alias("dd_frac"),
        R(F.min(F.col("before") - F.col("notional") * F.abs("mae")), 3).alias("worst_intratrade"))
    month = t.groupBy("model", bucket.alias("block")).agg(F.round(F.sum("pnl"), 5).alias("pnl"))
    return whole.join(stats.expected_shortfall(month, ["model"], "pnl", 0.05, 1000.0).select("model", R("es", 8).alias("period_es95")), "model")


EQUITY = f"""WITH {TRADES}, o AS (SELECT model, t_entry, l_orderkey * 8 + l_linenumber AS id, min(notional) AS notional, min(mae) AS mae, sum(ret * notional) AS pnl FROM tr GROUP BY ALL),
 a AS (SELECT *, {INITIAL} + sum(pnl) OVER w AS after, {INITIAL} + sum(pnl) OVER w - pnl AS before FROM o WINDOW w AS (PARTITION BY model ORDER BY t_entry, id ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, greatest({INITIAL}, max(after) OVER (PARTITION BY model ORDER BY t_entry, id ROWS UNBOUNDED PRECEDING)) AS peak FROM a),
 m AS (SELECT model, t_entry // {MONTH_NS} AS block, round(sum(pnl), 5) AS pnl FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY pnl) AS r, greatest(1, ceil(count(*) OVER (PARTITION BY model) * {_D(0.05)})) AS k FROM m), e AS (SELECT model, round(avg(pnl), 8) AS period_es95 FROM r WHERE r <= k GROUP BY model),
 x AS (SELECT model, arg_max(after, {{'t': t_entry, 'i': id}}) AS f, max(peak - after) AS d, max((peak - after) / peak) AS g, min(before - notional * abs(mae)) AS w FROM p GROUP BY model)
 SELECT model, round(f, 3) AS final, round(f / {INITIAL} - 1, 8) AS total_return, round(d, 3) AS dd_abs, round(g, 8) AS dd_frac, round(w, 3) AS worst_intratrade, period_es95 FROM x JOIN e USING (model)"""


def median_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median spread and impact of each symbol on the calibration rows of the traded venue, the last 30 % of its time."""
    q = quotes(spark, sf_dir).where("venue = 'lit'")
    span = q.agg(F.max("ts_local_ns").alias("hi"), F.min("ts_local_ns").alias("lo"))  # one row
    q = q.join(F.broadcast(span)).where(F.expr("ts_local_ns >= hi - (hi - lo) DIV 10 * 3"))
    spread = (F.col("ask_px") - F.col("bid_px")) / (F.col("ask_px") + F.col("bid_px")) * 2e4
    return q.groupBy("symbol").agg(R(F.median(spread)).alias("spread_bps"), R(F.median(spread / 2 + 10 / F.col("ask_sz"))).alias("impact_bps"))


COSTS = f"""WITH {QUOTES}, l AS (SELECT * FROM quotes WHERE venue = 'lit'), s AS (SELECT symbol, (ask_px - bid_px) / (ask_px + bid_px) * 2e4 AS s, ask_sz FROM l WHERE ts_local_ns >= (SELECT max(ts_local_ns) - (max(ts_local_ns) - min(ts_local_ns)) // 10 * 3 FROM l)) SELECT symbol, round(median(s), 6) AS spread_bps, round(median(s / 2 + 10 / ask_sz), 6) AS impact_bps FROM s GROUP BY symbol"""


def position_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions rolled up from fills counted once: quantity, entry price, pnl, fees and net return."""
    t = table(spark, sf_dir, "lineitem")
    one = t.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_quantity", "l_extendedprice", "l_tax", "l_discount")).alias("f"))
    entry = F.col("l_linenumber") <= 2
    when = lambda c, x: F.round(F.sum(F.when(c, x).otherwise(0.0)), 2)
    p = one.groupBy("l_orderkey").agg(
        when(entry, F.col("f.l_quantity")).alias("qty"), when(entry, F.col("f.l_extendedprice")).alias("paid"), when(~entry, F.col("f.l_quantity")).alias("sold"), when(~entry, F.col("f.l_extendedprice")).alias("got"),
        F.round(F.sum(F.col("f.l_extendedprice") * F.col("f.l_tax") / 100), 8).alias("fees"), F.round(F.sum(F.col("f.l_discount")), 2).alias("funding"))
    done = F.least("qty", "sold")
    p = p.where("qty > 0").withColumn("entry_px", F.col("paid") / F.col("qty")).withColumn("pnl", F.coalesce(done * (F.col("got") / F.nullif("sold", F.lit(0.0)) - F.col("entry_px")), F.lit(0.0)))
    return p.select("l_orderkey", R("qty", 4).alias("qty"), R("entry_px").alias("entry_px"), (F.col("sold") >= F.col("qty")).alias("done"), "pnl", "fees", R((F.col("pnl") - F.col("fees") - F.col("funding")) / F.col("paid"), 8).alias("net_return"))


LEDGER = """WITH o AS (SELECT l_orderkey, l_linenumber, min({'a': l_quantity, 'b': l_extendedprice, 'c': l_tax, 'd': l_discount}) AS f FROM lineitem GROUP BY ALL),
 p AS (SELECT l_orderkey, round(coalesce(sum(f.a) FILTER (l_linenumber <= 2), 0), 2) AS qty, round(coalesce(sum(f.b) FILTER (l_linenumber <= 2), 0), 2) AS paid, round(coalesce(sum(f.a) FILTER (l_linenumber > 2), 0), 2) AS sold, round(coalesce(sum(f.b) FILTER (l_linenumber > 2), 0), 2) AS got, round(sum(f.b * f.c / 100), 8) AS fees, round(sum(f.d), 2) AS funding FROM o GROUP BY l_orderkey),
 q AS (SELECT *, paid / qty AS entry_px, coalesce(least(qty, sold) * (got / nullif(sold, 0) - paid / qty), CAST(0 AS DOUBLE)) AS pnl FROM p WHERE qty > 0)
 SELECT l_orderkey, round(qty, 4) AS qty, round(entry_px, 6) AS entry_px, sold >= qty AS done, pnl, fees, round((pnl - fees - funding) / paid, 8) AS net_return FROM q"""


def walked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips by book walk (L01-L04, L07): enter for a notional after a latency, leave with what was entered a week later."""
    iv = written(level_intervals(spark, sf_dir))
    d = _instants(spark, sf_dir)
    late = lambda leg: F.floor(uniform("9", F.col("symbol"), F.col("epoch"), F.col("t"), leg) * HOUR).cast("long")
    d = d.select("symbol", "epoch", F.col("t").alias("ts_ns"), (F.col("t") + late("entry")).alias("t_in")).withColumn("t_out", F.col("t_in") + HOLD + F.floor(uniform("9", F.col("symbol"), F.col("epoch"), F.col("ts_ns"), "exit") * HOUR).cast("long"))
    keys = ["symbol", "epoch", "t"]
    at = lambda c: written(book.book_at(iv, d.select("symbol", "epoch", F.col(c).alias("t")), WEEK))
    usable = lambda b: book.top(b).where("bid_px < ask_px")
    b_in, b_out = at("t_in"), at("t_out")
    mid = usable(at("ts_ns")).select("symbol", "epoch", F.col("t").alias("ts_ns"), ((F.col("bid_px") + F.col("ask_px")) / 2).alias("mid"))
    entry = book.walk(b_in.join(usable(b_in).select(*keys), keys), keys, "notional", NOTIONAL).where("complete")
    sides = entry.groupBy(*keys).agg(*[F.max(F.when(F.col("taker") == s, F.col(c))).alias(f"{c}_{n}") for s, n in (("buy", "long"), ("sell", "short")) for c in ("vwap", "qty")]).withColumnRenamed("t", "t_in")
    d = d.join(sides, ["symbol", "epoch", "t_in"], "left").join(mid, ["symbol", "epoch", "ts_ns"], "left")
    due = d.select("symbol", "epoch", F.col("t_out").alias("t"), "qty_long", "qty_short")
    leave = b_out.join(usable(b_out).select(*keys), keys).join(due, keys).withColumn("target", F.when(F.col("side") == "bid", F.col("qty_long")).otherwise(F.col("qty_short"))).where("target is not null")
    left = book.walk(leave, keys, "qty", "target").where("complete")
    outs = left.groupBy(*keys).agg(*[F.max(F.when(F.col("taker") == s, F.col("vwap"))).alias(f"out_{n}") for s, n in (("sell", "long"), ("buy", "short"))]).withColumnRenamed("t", "t_out")
    d = d.join(outs, ["symbol", "epoch", "t_out"], "left")
    return d.selectExpr(*WALKED)


def _walked(name: str, sign: int) -> list[str]:
    px, out = f"vwap_{name}", f"out_{name}"
    return [
        f"round({px}, 6) AS entry_px_{name}", f"round(qty_{name}, 5) AS qty_{name}", f"round(({px} / mid - 1) * 1e4 * {sign}, 4) AS slip_bps_{name}", f"round(({out} - {px}) / {px} * {sign}, 8) AS gross_{name}",
        f"round(({out} - {px}) / {px} * {sign} - {_D(TAKER)} * ({px} + {out}) / {px}, 8) AS ret_{name}"]


WALKED = ["symbol", "epoch", "ts_ns", "(t_out - t_in) / 1e6 AS hold_ms", *_walked("long", 1), *_walked("short", -1)]
_LATE = lambda leg: f"CAST(floor({_DRAW.format(parts=f"'9', symbol, CAST(epoch AS VARCHAR), CAST(t AS VARCHAR), '{leg}'")} * {HOUR}) AS BIGINT)"


def _book_sql(name: str, at: str) -> str:
    """Books at a column of the decisions, where both sides are there and don't cross."""
    return f"""{name} AS (SELECT * FROM (SELECT d.*, side, price, size, max(CASE WHEN side = 'bid' THEN price END) OVER e AS bb, min(CASE WHEN side = 'ask' THEN price END) OVER e AS ba
  FROM dc d JOIN iv ON d.symbol = iv.symbol AND d.epoch = iv.epoch AND d.{at} >= valid_from AND (valid_to IS NULL OR d.{at} < valid_to) WINDOW e AS (PARTITION BY d.symbol, d.epoch, d.ts_ns)) WHERE bb < ba)"""


_OUTWARD = "ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END ROWS UNBOUNDED PRECEDING"
WALKED_SQL = f"""WITH {INTERVALS}, {_INSTANTS}, d0 AS (SELECT symbol, epoch, t AS ts_ns, t + {_LATE('entry')} AS t_in, {_LATE('exit')} AS l2 FROM instants), dc AS (SELECT symbol, epoch, ts_ns, t_in, t_in + {HOLD} + l2 AS t_out FROM d0),
 {_book_sql('bd', 'ts_ns')}, {_book_sql('bi', 't_in')}, {_book_sql('bo', 't_out')}, md AS (SELECT symbol, epoch, ts_ns, any_value((bb + ba) / 2) AS mid FROM bd GROUP BY ALL),
 ic AS (SELECT *, sum(price * size) OVER w - price * size AS before FROM bi WINDOW w AS (PARTITION BY symbol, epoch, ts_ns, side {_OUTWARD})), it AS (SELECT *, greatest(0, least(price * size, {NOTIONAL} - before)) / price AS take FROM ic),
 ix AS (SELECT symbol, epoch, ts_ns, side, sum(take * price) / sum(take) AS vwap, sum(take) AS qty FROM it GROUP BY ALL HAVING sum(price * size) >= {NOTIONAL} - 1e-6),
 en AS (SELECT symbol, epoch, ts_ns, """ + ", ".join(f"max({c}) FILTER (side = '{s}') AS {c}_{n}" for s, n in (("ask", "long"), ("bid", "short")) for c in ("vwap", "qty")) + f""" FROM ix GROUP BY ALL),
 oc AS (SELECT bo.*, CASE WHEN side = 'bid' THEN qty_long ELSE qty_short END AS target, sum(size) OVER w - size AS before FROM bo JOIN en USING (symbol, epoch, ts_ns) WINDOW w AS (PARTITION BY bo.symbol, bo.epoch, bo.ts_ns, side {_OUTWARD})),
 ox AS (SELECT symbol, epoch, ts_ns, side, sum(greatest(0, least(size, target - before)) * price) / sum(greatest(0, least(size, target - before))) AS vwap FROM oc WHERE target IS NOT NULL GROUP BY symbol, epoch, ts_ns, side, target HAVING sum(size) >= target - 1e-6),
 ou AS (SELECT symbol, epoch, ts_ns, max(vwap) FILTER (side = 'bid') AS out_long, max(vwap) FILTER (side = 'ask') AS out_short FROM ox GROUP BY ALL)
 SELECT {', '.join(WALKED)} FROM dc LEFT JOIN md USING (symbol, epoch, ts_ns) LEFT JOIN en USING (symbol, epoch, ts_ns) LEFT JOIN ou USING (symbol, epoch, ts_ns)"""


def passive_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of filled resting orders, left by a taker six hours and a latency after the fill (L10); an exit that the data
    don't reach stays open (L11)."""
    f = passive_fill(spark, sf_dir).where("filled = 1")
    q = quotes(spark, sf_dir)
    late = F.floor(uniform("7", F.col("symbol"), F.col("ts_ns"), "pexit") * 1_000_000_000).cast("long")
    f = f.select("symbol", "ts_ns", (F.col("ts_ns") + F.round(F.col("wait_s") * 1000).cast("long") * 1_000_000).alias("t_fill")).withColumn("t_out", F.col("t_fill") + 6 * HOUR + late)
    lit = q.where("venue = 'lit'")
    px = asof_join(f, lit.select("symbol", "ts_local_ns", "event_id", F.floor("bid_px").cast("double").alias("px_in")), ["symbol"], "ts_ns", "ts_local_ns", ["px_in"], DAY, "event_id")
    out = asof_join(px, lit.select("symbol", "ts_local_ns", "event_id", F.col("bid_px").alias("px_out")), ["symbol"], "t_out", "ts_local_ns", ["px_out"], DAY, "event_id")
    end = lit.agg(F.max("ts_local_ns").alias("end"))  # one row
    out = out.join(F.broadcast(end)).withColumn("px_out", F.when(F.col("t_out") <= F.col("end"), F.col("px_out")))
    net = (F.col("px_out") - F.col("px_in")) / F.col("px_in") - MAKER - TAKER * F.col("px_out") / F.col("px_in")
    return out.select("symbol", "ts_ns", F.round(net, 8).alias("pret_long"), (F.col("t_out") <= F.col("end")).alias("complete"))


PASSIVE_OUT = f"""WITH pf AS ({PASSIVE}), e3 AS (WITH {_ENTRIES} SELECT symbol, ts_ns, floor(bid) AS px_in FROM en), q3 AS (WITH {QUOTES} SELECT symbol, ts_local_ns, max_by(bid_px, event_id) AS bid_px FROM quotes WHERE venue = 'lit' GROUP BY ALL),
 f AS (SELECT pf.symbol, pf.ts_ns, px_in, pf.ts_ns + CAST(round(wait_s * 1000) AS BIGINT) * 1000000 + 6 * {HOUR} + CAST(floor({_DRAW.format(parts="'7', pf.symbol, CAST(pf.ts_ns AS VARCHAR), 'pexit'")} * 1000000000) AS BIGINT) AS t_out FROM pf JOIN e3 ON pf.symbol = e3.symbol AND pf.ts_ns = e3.ts_ns WHERE filled = 1),
 o AS (SELECT f.*, bid_px, t_out <= (SELECT max(ts_local_ns) FROM q3) AS complete FROM f ASOF LEFT JOIN q3 ON f.symbol = q3.symbol AND f.t_out >= q3.ts_local_ns)
 SELECT symbol, ts_ns, round(CASE WHEN complete THEN (bid_px - px_in) / px_in - {_D(MAKER)} - {_D(TAKER)} * bid_px / px_in END, 8) AS pret_long, complete FROM o"""

RESTING = outcomes.Passive(HOUR, 4 * HOUR, 12 * HOUR, (("1", HOUR), ("6", 6 * HOUR)), 1_000_000_000, MAKER, TAKER, "8")
#: Days of a chunk of labels.
CHUNK_DAYS = 10


def passive_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resting orders of both sides and their results by horizon, built in chunks of ten days apart from each other."""
    q = quotes(spark, sf_dir).where("venue = 'lit'")
    top = q.select("symbol", F.col("ts_local_ns").alias("ts"), F.col("event_id").alias("id"), F.floor("bid_px").cast("double").alias("bid"), "bid_sz", F.ceil("ask_px").cast("double").alias("ask"), "ask_sz")
    taker = F.when(F.expr("event_id DIV 2") % 2 == 0, 1).otherwise(-1)
    t = q.where("event_type = 'purchase'").select("symbol", F.col("ts_local_ns").alias("ts"), F.col("event_id").alias("id"), taker.alias("taker"), F.when(taker == 1, F.ceil("ask_px")).otherwise(F.floor("bid_px")).cast("double").alias("px"), F.col("ask_sz").alias("sz"))
    lo, hi = q.agg(F.min("ts_local_ns"), F.max("ts_local_ns")).first()
    chunk = CHUNK_DAYS * DAY
    parts = [outcomes.passive_labels(top, t, max(lo, a), min(a + chunk, hi + 1), hi, RESTING, DAY) for a in range(lo // chunk * chunk, hi + 1, chunk)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


_OUT_DRAW = lambda n: _DRAW.format(parts=f"'8', o.symbol, CAST(o.ts_ns AS VARCHAR), CAST(o.side AS VARCHAR), '{n}'")
PASSIVE_LABELS = f"""WITH {QUOTES}, l AS (SELECT * FROM quotes WHERE venue = 'lit'), m AS (SELECT symbol, ts_local_ns AS ts, arg_max({{'b': floor(bid_px), 'bs': bid_sz, 'a': ceil(ask_px), 'as': ask_sz}}, event_id) AS x FROM l GROUP BY ALL), sp AS (SELECT min(ts_local_ns) AS lo, max(ts_local_ns) AS hi FROM l),
 d AS (SELECT DISTINCT symbol, h * {HOUR} AS ts_ns FROM (SELECT DISTINCT symbol FROM l), (SELECT unnest(range(-(-lo // {HOUR}), hi // {HOUR} + 1)) AS h FROM sp) WHERE h * {HOUR} >= (SELECT lo FROM sp)),
 e AS (SELECT d.*, x FROM d ASOF JOIN m ON d.symbol = m.symbol AND d.ts_ns >= m.ts WHERE d.ts_ns - m.ts <= {RESTING.fresh}), o AS (SELECT symbol, ts_ns, 1 AS side, x.b AS rest, x.bs AS queue FROM e UNION ALL SELECT symbol, ts_ns, -1, x.a, x."as" FROM e),
 t AS (SELECT symbol, ts_local_ns AS ts, event_id AS id, CASE WHEN event_id // 2 % 2 = 0 THEN 1 ELSE -1 END AS taker, CASE WHEN event_id // 2 % 2 = 0 THEN ceil(ask_px) ELSE floor(bid_px) END AS px, ask_sz AS sz FROM l WHERE event_type = 'purchase'),
 h AS (SELECT o.*, t.ts, (px - rest) * side AS through, sum(CASE WHEN px = rest THEN sz ELSE 0 END) OVER (PARTITION BY o.symbol, o.ts_ns, side ORDER BY t.ts, id ROWS UNBOUNDED PRECEDING) AS seen FROM o JOIN t ON t.symbol = o.symbol AND taker = -side AND t.ts > o.ts_ns AND t.ts <= o.ts_ns + {RESTING.wait}),
 f AS (SELECT symbol, ts_ns, side, min(ts) AS t_fill FROM h WHERE through < 0 OR (through = 0 AND seen >= queue + 1) GROUP BY ALL), g AS (SELECT o.*, t_fill FROM o LEFT JOIN f USING (symbol, ts_ns, side)),
 u AS ({" UNION ALL ".join(f"SELECT o.*, '{n}' AS h, t_fill + {h} + CAST(floor({_OUT_DRAW(n)} * 1000000000) AS BIGINT) AS t_out FROM g o WHERE t_fill IS NOT NULL" for n, h in RESTING.horizons)}),
 v AS (SELECT u.*, CASE WHEN side = 1 THEN m.x.b ELSE m.x.a END AS px FROM u ASOF JOIN m ON u.symbol = m.symbol AND u.t_out >= m.ts WHERE t_out <= (SELECT hi FROM sp)),
 w AS (SELECT symbol, ts_ns, side, h, round((px - rest) / rest * side - {_D(MAKER)} - {_D(TAKER)} * px / rest, 8) AS net FROM v),
 p AS (SELECT symbol, ts_ns, {", ".join(f"max(net) FILTER (side = {s} AND h = '{n}') AS pret_{k}_{n}" for k, s in outcomes.SIDES.items() for n, _ in RESTING.horizons)} FROM w GROUP BY ALL)
 SELECT g.symbol, g.ts_ns, {", ".join(f"max(rest) FILTER (side = {s}) AS ppx_{k}, max(CASE WHEN t_fill IS NOT NULL THEN 1 WHEN g.ts_ns + {RESTING.wait} <= (SELECT hi FROM sp) THEN 0 END) FILTER (side = {s}) AS pfill_{k}, max(round((t_fill - g.ts_ns) / 1e6, 3)) FILTER (side = {s}) AS pwait_ms_{k}" for k, s in outcomes.SIDES.items())},
 {", ".join(f"any_value(pret_{k}_{n}) AS pret_{k}_{n}" for k in outcomes.SIDES for n, _ in RESTING.horizons)} FROM g LEFT JOIN p USING (symbol, ts_ns) GROUP BY g.symbol, g.ts_ns"""

SYMBOLS, LEAST_TRADES = 8, 50


def policy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of each side with the largest min(trades, capacity) times lower bound, where that is positive (M14); the
    tape's returns lie around 0, so trades here earn a cent more."""
    t = tape(spark, sf_dir).withColumn("ret", F.col("ret") + 0.01)
    c = beyond_thresholds(t).where((F.col("n") >= LEAST_TRADES) & (F.col("lcb") > 0))
    capacity = SYMBOLS * 2555 * 86_400 / (3600.0 + 1)
    gain = F.least(F.col("n").cast("double"), F.lit(capacity)) * F.col("lcb")
    best = c.groupBy("mode").agg(F.max_by(F.struct("k", "n", "mean", "lcb"), F.struct(gain, -F.col("k"))).alias("b"))
    return best.select("mode", "b.*")


POLICY = f"""WITH c AS ({THRESHOLDS.replace('sum(ret) AS s', f'sum(ret + {_D(0.01)}) AS s')}) SELECT mode, k, n, mean, lcb FROM c WHERE n >= {LEAST_TRADES} AND lcb > 0 QUALIFY row_number() OVER (PARTITION BY mode ORDER BY least(CAST(n AS DOUBLE), {SYMBOLS * 2555 * 86_400 / 3601.0!r}) * lcb DESC, k) = 1"""

#: Models from the simplest to the most complex; the first is a baseline.
COMPLEXITY = {"R": 1, "N": 2, "A": 3}
FOLD = 6 * MONTH_NS


def champion_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each model and execution isn't credible; of the credible the simplest not significantly worse than the best; and
    whether it beats the baseline (E06, M13).

    Paired differences resample months of two series; there are as many series as models times executions."""
    t = trades(spark, sf_dir).withColumn("block", F.floor(F.col("t_entry") / MONTH_NS))
    ci = stats.cluster_bootstrap(t, BY, "ret", "block", REPS, 0.9, "21")
    folds = t.groupBy(*BY, F.floor(F.col("t_entry") / FOLD).alias("fold")).agg(F.avg("ret").alias("m")).groupBy(*BY).agg(F.count("*").alias("folds"), F.count(F.when(F.col("m") > 0, 1)).alias("positive"))
    a = t.groupBy(*BY).agg(F.count("*").alias("n"), stats.profit_factor("ret").alias("pf")).join(ci, BY).join(folds, BY)
    few = F.col("n") < 30
    checks = F.array(
        F.when(few, F.lit("too_few_trades")), F.when(~few & ~(F.col("lo") > 0), F.lit("interval_not_positive")), F.when(~few & ~(F.col("pf") > 1), F.lit("profit_factor")),
        F.when(~few & (F.col("positive") < F.ceil(F.col("folds") / 2 + 0.01)), F.lit("positive_in_few_folds")))
    a = a.withColumn("reasons", F.array_join(F.array_compact(checks), ","))
    month = written(t.groupBy(*BY, "block").agg(F.sum("ret").alias("v")))
    span = month.agg(F.min("block").alias("lo"), F.max("block").alias("hi")).first()
    n = span["hi"] - span["lo"] + 1
    mean = month.groupBy(*BY).agg((F.sum("v") / n).alias("period_mean"))
    a = written(a.join(mean, BY).select(*BY, "n", "reasons", "period_mean", F.create_map(*[F.lit(x) for kv in COMPLEXITY.items() for x in kv])[F.col("model")].alias("complexity")))
    best = a.where("reasons = ''").agg(F.max_by(F.struct(*BY), "period_mean").alias("b")).select(F.col("b.model").alias("bm"), F.col("b.exec_mode").alias("be"))  # one row
    paths = stats.stationary_paths(n, 4.0, REPS, "5", spark)
    idx = month.withColumn("idx", (F.col("block") - span["lo"]).cast("int"))
    boot = paths.join(idx, "idx").groupBy("rep", *BY).agg((F.sum("v") / n).alias("m"))
    top = boot.join(F.broadcast(best), (F.col("model") == F.col("bm")) & (F.col("exec_mode") == F.col("be"))).select("rep", F.col("m").alias("mb"))
    top_mean = a.join(F.broadcast(best), (F.col("model") == F.col("bm")) & (F.col("exec_mode") == F.col("be"))).select(F.col("period_mean").alias("best_mean"))
    d = boot.join(top, "rep").join(mean, BY).join(F.broadcast(top_mean))
    gap = F.col("best_mean") - F.col("period_mean")
    p = d.groupBy(*BY).agg(F.avg((F.col("mb") - F.col("m") - gap >= gap).cast("int")).alias("p"))
    a = a.join(p, BY, "left").join(F.broadcast(best), F.lit(True), "left")
    is_best = (F.col("model") == F.col("bm")) & (F.col("exec_mode") == F.col("be"))
    eligible = (F.col("reasons") == "") & (is_best | (F.col("p") > 0.05))
    order = F.struct("complexity", (F.col("exec_mode") != "aggressive"), ~is_best)
    chosen = a.where(eligible).agg(F.min_by(F.struct(*BY), order).alias("c"))
    return a.join(F.broadcast(chosen)).select(*BY, "reasons", R("period_mean", 8).alias("period_mean"), R("p", 4).alias("p_worse"), F.coalesce((F.col("model") == F.col("c.model")) & (F.col("exec_mode") == F.col("c.exec_mode")), F.lit(False)).alias("chosen"))


CHAMPION = f"""WITH {TRADES}, {_boot_sql(_BY, '21')}, fo AS (SELECT {_BY}, t_entry // {FOLD} AS fold, avg(ret) AS m FROM tr GROUP BY ALL), ff AS (SELECT {_BY}, count(*) AS folds, count(*) FILTER (m > 0) AS positive FROM fo GROUP BY ALL),
 aa AS (SELECT {_BY}, count(*) AS n, sum(greatest(ret, 0)) / sum(greatest(-ret, 0)) AS pf FROM tr GROUP BY ALL), mo AS (SELECT {_BY}, t_entry // {MONTH_NS} AS block, sum(ret) AS v FROM tr GROUP BY ALL), sp AS (SELECT min(block) AS lo, max(block) - min(block) + 1 AS len FROM mo),
 me AS (SELECT {_BY}, sum(v) / any_value(len) AS pm FROM mo, sp GROUP BY ALL),
 re AS (SELECT aa.*, pm, CASE model {" ".join(f"WHEN '{k}' THEN {v}" for k, v in COMPLEXITY.items())} END AS complexity, array_to_string(list_filter([CASE WHEN n < 30 THEN 'too_few_trades' END, CASE WHEN n >= 30 AND NOT lo > 0 THEN 'interval_not_positive' END, CASE WHEN n >= 30 AND NOT pf > 1 THEN 'profit_factor' END,
  CASE WHEN n >= 30 AND positive < ceil(folds / 2 + {_D(0.01)}) THEN 'positive_in_few_folds' END], lambda v: v IS NOT NULL), ',') AS reasons FROM aa JOIN ci USING ({_BY}) JOIN ff USING ({_BY}) JOIN me USING ({_BY})),
 be AS (SELECT model AS bm, exec_mode AS bx, pm AS bp FROM re WHERE reasons = '' ORDER BY pm DESC LIMIT 1),
 q AS (SELECT rep, t, len, t = 0 OR {_DRAW.format(parts="'5', CAST(rep AS VARCHAR), CAST(t AS VARCHAR), 'r'")} < 0.25 AS restart, CAST(floor({_DRAW.format(parts="'5', CAST(rep AS VARCHAR), CAST(t AS VARCHAR), 'i'")} * len) AS BIGINT) AS i
  FROM (SELECT unnest(range(1, {REPS + 1})) AS rep) CROSS JOIN (SELECT unnest(range((SELECT len FROM sp))) AS t) CROSS JOIN sp), w AS (SELECT rep, (last_value(CASE WHEN restart THEN i - t END IGNORE NULLS) OVER (PARTITION BY rep ORDER BY t) + t) % len AS idx FROM q),
 bo AS (SELECT rep, {_BY}, sum(v) / any_value(len) AS m FROM w JOIN (SELECT mo.*, block - lo AS idx, len FROM mo, sp) USING (idx) GROUP BY rep, {_BY}), tp AS (SELECT rep, m AS mb FROM bo, be WHERE model = bm AND exec_mode = bx),
 pv AS (SELECT {_BY}, avg(CASE WHEN mb - m - (bp - pm) >= bp - pm THEN 1 ELSE 0 END) AS p FROM bo JOIN tp USING (rep) JOIN me USING ({_BY}) CROSS JOIN be GROUP BY {_BY}),
 ch AS (SELECT re.model AS cm, re.exec_mode AS cx FROM re JOIN pv USING ({_BY}) CROSS JOIN be WHERE reasons = '' AND (p > {_D(0.05)} OR (model = bm AND exec_mode = bx)) ORDER BY complexity, exec_mode <> 'aggressive', NOT (model = bm AND exec_mode = bx) LIMIT 1)
 SELECT model, exec_mode, reasons, round(pm, 8) AS period_mean, round(p, 4) AS p_worse, coalesce(model = cm AND exec_mode = cx, false) AS chosen FROM re LEFT JOIN pv USING ({_BY}) LEFT JOIN ch ON true"""


def prior_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies drawn for decisions from the lognormal prior by a fixed table of its quantiles (C02): draws pick a row of the table."""
    import math
    from statistics import NormalDist

    rows = [(i, math.exp(math.log(400.0) + 0.7 * NormalDist().inv_cdf((i + 0.5) / 1024))) for i in range(1024)]
    prior = spark.createDataFrame(rows, "i int, ms double")
    q = quotes(spark, sf_dir).select("event_id", F.floor(uniform("3", F.col("event_id")) * 1024).cast("int").alias("i"))
    return q.join(F.broadcast(prior), "i").select("event_id", "i", R("ms", 3).alias("latency_ms"))


def unseen_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that a champion has not seen, beside its challenger's, missing ones 0."""
    t = trades(spark, sf_dir).withColumn("block", F.floor(F.col("t_entry") / MONTH_NS))
    cal_end = 883_612_800_000_000_000
    month = t.where(F.col("block") >= cal_end // MONTH_NS + 1).groupBy("block").pivot("model", ["A", "N"]).agg(F.sum("ret"))
    return month.select("block", *[R(F.coalesce(m, F.lit(0.0)), 7).alias(m.lower()) for m in ("A", "N")])


UNSEEN = f"""WITH {TRADES} SELECT t_entry // {MONTH_NS} AS block, round(coalesce(sum(ret) FILTER (model = 'A'), 0), 7) AS a, round(coalesce(sum(ret) FILTER (model = 'N'), 0), 7) AS n FROM tr WHERE t_entry // {MONTH_NS} >= {883_612_800_000_000_000 // MONTH_NS + 1} GROUP BY 1"""

LIMITS = {"reserve": 10.0, "kappa": 0.25, "z": 1.645, "min_lcb": 0.0, "position_cap": 1.5, "gross_cap": 2.2, "margin_cap": 0.6, "loss_share": 0.01, "max_notional": 1500.0}


def position_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes less covariance with open positions under five caps, with the reason of each refusal."""
    k, c = F.col("p_partkey"), F.col
    p = table(spark, sf_dir, "part")
    held = lambda i: F.struct(F.when((k + i) % 2 == 0, 1).otherwise(-1).alias("side"), (100.0 * (k % 7 + i)).alias("notional"), F.lit(0.003 + i / 1000).alias("sd"), F.lit(2.0 + i).alias("leverage"), F.lit(0.5 - i / 10).alias("corr"))
    d = p.select(
        "p_partkey", (F.lit(500.0) + k % 9 * 100).alias("equity"), F.when(k % 2 == 0, 1).otherwise(-1).alias("side"), ((c("p_size") - 10) / 10000).alias("mu"), ((k % 5) / 10000).alias("se"), F.when(k % 29 == 0, 0.0).otherwise(0.02 + k % 3 / 100).alias("sd"),
        (-F.lit(0.004) - k % 4 / 1000).alias("es"), c("p_retailprice").alias("price"), (c("p_size") % 4).alias("decimals"), (k % 3 / 10 + 0.1).alias("min_base"), F.lit(10.0).alias("min_quote"), (F.lit(2.0) + k % 4).alias("market_leverage"),
        F.when(k % 31 == 0, 0.0).otherwise(1.0).alias("multiplier"), F.slice(F.array(held(0), held(1)), 1, (k % 3).cast("int")).alias("open_positions"))
    s = risk.allocate(d, **LIMITS)
    return s.select("p_partkey", "leverage", R("fraction", 8).alias("fraction"), R("qty").alias("qty"), "size_reason")


def _held_sql(f: str) -> str:
    """The sum of ``f`` over the positions of a row."""
    one = [f.format(side=f"(CASE WHEN (k + {i}) % 2 = 0 THEN 1 ELSE -1 END)", notional=f"(100.0 * (k % 7 + {i}))", sd=repr(0.003 + i / 1000), leverage=repr(2.0 + i), corr=repr(0.5 - i / 10)) for i in (0, 1)]
    return f"CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN {one[0]} ELSE {one[0]} + {one[1]} END"


_L = LIMITS
SIZES = f"""WITH d AS (SELECT p_partkey AS k, 500 + p_partkey % 9 * 100 - {_D(_L['reserve'])} AS e, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS sd1, (p_size - 10) / {_D(10000)} - {_D(_L['z'])} * ((p_partkey % 5) / {_D(10000)}) AS lcb,
  CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE {_D(0.02)} + p_partkey % 3 / {_D(100)} END AS sd, {_D(0.004)} + p_partkey % 4 / {_D(1000)} AS es, p_retailprice AS price, p_size % 4 AS dec, p_partkey % 3 / {_D(10)} + {_D(0.1)} AS mb,
  greatest(CAST(1 AS DOUBLE), least(CAST(2 + p_partkey % 4 AS DOUBLE), ceil({_D(_L['gross_cap'])}))) AS lev, CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE 1 END AS mult FROM part),
 h AS (SELECT *, CAST({_held_sql('{side} * {notional} / e * {corr} * sd * {sd} * sd1')} AS DOUBLE) AS cov, CAST({_held_sql('{notional}')} AS DOUBLE) / e AS gross, CAST({_held_sql('{notional} / {leverage}')} AS DOUBLE) / e AS margin FROM d),
 o AS (SELECT *, CASE WHEN sd > 0 THEN (lcb - cov) / (sd * sd) END AS opt, {_D(_L['gross_cap'])} - gross AS c2, ({_D(_L['margin_cap'])} - margin) * lev AS c3, {_D(_L['loss_share'])} / es AS c4, {_D(_L['max_notional'])} / e AS c5 FROM h),
 p AS (SELECT *, least({_D(_L['position_cap'])}, c2, c3, c4, c5) AS cap FROM o),
 q AS (SELECT *, CASE WHEN e <= 0 THEN 'no_free_equity' WHEN mult <= 0 THEN 'risk_halt' WHEN NOT lcb > 0 THEN 'ev_lcb_not_positive' WHEN NOT sd > 0 THEN 'invalid_risk_estimate' WHEN opt <= 0 THEN 'portfolio_correlation' WHEN cap <= 0 THEN
  CASE cap WHEN c2 THEN 'cap_gross_exhausted' WHEN c3 THEN 'cap_margin_exhausted' WHEN c4 THEN 'cap_loss_budget_exhausted' ELSE 'cap_validated_notional_exhausted' END END AS refused, least({_D(_L['kappa'])} * opt * mult, cap) AS f FROM p),
 r AS (SELECT *, floor(CAST(f * e / price AS DECIMAL(28,10)) * CAST(pow(10, dec) AS DECIMAL(9,0))) / pow(10, dec) AS raw, round(ceil(greatest(mb, 10 / price) / pow(10.0, -dec) - {_D(1e-9)}) * pow(10.0, -dec), 10) AS qmin FROM q),
 s AS (SELECT *, raw + {_D(1e-12)} >= mb AND raw * price + {_D(1e-9)} >= 10 AS feasible, qmin * price / e AS fmin FROM r), t AS (SELECT *, fmin <= cap AND fmin * lcb - 0.5 * fmin * fmin * sd * sd - fmin * cov > 0 AS lifted FROM s),
 u AS (SELECT k, e, price, lev, CASE WHEN refused IS NOT NULL THEN 0 WHEN feasible THEN raw WHEN lifted THEN qmin ELSE 0 END AS qty, coalesce(refused, CASE WHEN feasible THEN 'ok' WHEN lifted THEN 'raised_to_exchange_minimum' WHEN fmin > cap THEN 'below_exchange_minimum_cap' ELSE 'below_exchange_minimum_negative_growth' END) AS size_reason FROM t)
 SELECT k AS p_partkey, lev AS leverage, round(qty * price / e, 8) AS fraction, round(qty, 6) AS qty, size_reason FROM u"""

def paired(spark: SparkSession, sf_dir: str, a: tuple[str, str], b: tuple[str, str], since: int = 0) -> tuple[float, float]:
    """Mean monthly difference of two series (model, execution) from block ``since`` on, and the one-sided p that it is none."""
    t = trades(spark, sf_dir).withColumn("block", F.floor(F.col("t_entry") / MONTH_NS)).where(F.col("block") >= since)
    is_a, is_b = ((F.col("model") == m) & (F.col("exec_mode") == e) for m, e in (a, b))
    d = t.where(is_a | is_b).groupBy("block").agg(F.sum(F.when(is_a, F.col("ret")).otherwise(-F.col("ret"))).alias("d"))
    span = t.agg(F.min("block").alias("lo"), F.max("block").alias("hi")).first()
    n = span["hi"] - span["lo"] + 1
    mean = (d.agg(F.sum("d")).first()[0] or 0.0) / n
    idx = d.select((F.col("block") - span["lo"]).cast("int").alias("idx"), "d")
    reps = stats.stationary_paths(n, 4.0, REPS, "5", spark).join(idx, "idx", "left").groupBy("rep").agg((F.sum(F.coalesce("d", F.lit(0.0))) / n).alias("m"))
    return mean, reps.agg(F.avg((F.col("m") - mean >= mean).cast("int"))).first()[0]


def comparison_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each execution: mean period result and deflated ratio of each model, each against the baseline, the best against
    nothing and against the baseline, and the probability of overfitting (E05, E07).

    Series have one row a model and month; the driver gets a few numbers."""
    t = trades(spark, sf_dir).withColumn("block", F.floor(F.col("t_entry") / MONTH_NS))
    lo, hi = t.agg(F.min("block"), F.max("block")).first()
    n, base = hi - lo + 1, min(COMPLEXITY, key=COMPLEXITY.get)
    paths = written(stats.stationary_paths(n, 4.0, REPS, "5", spark))
    calendar = spark.createDataFrame([(m, i) for m in COMPLEXITY for i in range(n)], "model string, idx int")
    out = []
    for mode in ("aggressive", "passive"):
        sums = t.where(F.col("exec_mode") == mode).groupBy("model", (F.col("block") - lo).cast("int").alias("idx")).agg(F.sum("ret").alias("value"))
        s = written(calendar.join(sums, ["model", "idx"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))))
        moments = s.groupBy("model").agg(F.avg("value").alias("mean"), (F.avg("value") / F.stddev_samp("value")).alias("sharpe"), F.skewness("value").alias("skew"), (F.kurtosis("value") + 3).alias("kurtosis")).collect()
        ratios = [r["sharpe"] for r in moments]
        spread = sum((x - sum(ratios) / len(ratios)) ** 2 for x in ratios) / len(ratios)
        for r in moments:
            out += [(mode, "mean", r["model"], r["mean"]), (mode, "deflated_sharpe", r["model"], stats.deflated_sharpe(n, r["sharpe"], r["skew"], r["kurtosis"], len(moments) * 2 * 3 * 8, spread))]
            if r["model"] != base:
                out.append((mode, "p_against_baseline", r["model"], float(paired(spark, sf_dir, (r["model"], mode), (base, mode))[1])))
        own = s.where(F.col("model") == base).select("idx", F.col("value").alias("b"))
        over = s.where(F.col("model") != base).join(own, "idx").select("model", "idx", (F.col("value") - F.col("b")).alias("value"))
        overfit = stats.pbo(s, "idx", "model", "value").agg(F.avg((F.col("logit") <= 0).cast("int"))).first()[0]
        out += [(mode, "spa_against_nothing", None, spa(paths, s, n).first()["p"]), (mode, "spa_against_baseline", None, spa(paths, over, n).first()["p"]), (mode, "pbo", None, overfit)]
    return spark.createDataFrame(out, "exec_mode string, metric string, model string, value double")


#: What a promotion asks for.
GATE = {"periods": 3, "trades": 200, "alpha": 0.05, "pbo": 0.3, "dsr": 0.9}


def gate_checks(f: dict) -> list[tuple[str, bool, str]]:
    """The twelve checks of a promotion with their details, from the facts of one evaluation; without a champion the first three."""
    out = [
        ("data_recorded", not f["synthetic"], "synthetic" if f["synthetic"] else "recorded"), ("latency_measured", f["samples"] >= 30, f"{f['samples']} samples"),
        ("credible_selection", f["champion"] is not None, "/".join(f["champion"]) if f["champion"] else "none")]
    if f["champion"] is None:
        return out
    dsr, same = f["dsr"], f["champion"] == f["present"]
    return [
        *out, ("oos_periods", f["folds"] >= GATE["periods"], f"{f['folds']} periods"), ("min_trades", f["trades"] >= GATE["trades"], f"{f['trades']} trades"), ("net_ci_positive", f["ci_lo"] > 0, f"{f['ci_lo']:.6f}"),
        ("spa_vs_no_trading", f["spa"] < GATE["alpha"], f"p {f['spa']:.4f}"), ("beats_baselines", f["gain"] > 0 and f["gain_p"] < GATE["alpha"], f"{f['gain']:.6f}, p {f['gain_p']:.4f}"), ("pbo", f["pbo"] <= GATE["pbo"], f"{f['pbo']:.4f}"),
        ("deflated_sharpe", dsr is not None and dsr >= GATE["dsr"], "none" if dsr is None else f"{dsr:.4f}"), ("reproducible", len(f["digests"]) == 1, ",".join(sorted(f["digests"]))),
        ("beats_champion", same or (f["unseen"] > 0 and f["unseen_p"] < GATE["alpha"]), "is the champion" if same else f"{f['unseen']:.6f}, p {f['unseen_p']:.4f}")]


def metrics_digest(t: DataFrame) -> str:
    """A digest of the metrics of each model and execution: a few rows."""
    rows = metrics(t, BY)
    line = F.to_json(F.struct(*sorted(rows.columns)))
    return rows.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256), 1, 16)).first()[0]


def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve checks of a promotion with their details, and whether all pass (T11): recorded data, measured latency, a credible
    champion, periods, trades, interval, both tests against nothing and the baseline, overfitting, deflated ratio,
    reproduction with other partitions, and the present champion on months it has not seen.

    All of it comes from one table of trades; the driver gets a few numbers and compares them."""
    t = written(trades(spark, sf_dir))
    chosen = champion_choice(spark, sf_dir).where("chosen").first()
    facts = {
        "synthetic": data_span(spark, sf_dir).agg(F.max("synthetic")).first()[0], "samples": exec_latency_match(spark, sf_dir).count(),
        "champion": (chosen["model"], chosen["exec_mode"]) if chosen is not None else None, "present": ("A", "aggressive")}
    if chosen is not None:
        key = facts["champion"]
        own = t.where((F.col("model") == key[0]) & (F.col("exec_mode") == key[1]))
        m = trade_metrics(spark, sf_dir).where((F.col("model") == key[0]) & (F.col("exec_mode") == key[1])).first()
        bundle = {(r["exec_mode"], r["metric"], r["model"]): r["value"] for r in comparison_bundle(spark, sf_dir).collect()}
        gain, gain_p = paired(spark, sf_dir, key, (min(COMPLEXITY, key=COMPLEXITY.get), key[1]))
        unseen, unseen_p = paired(spark, sf_dir, key, facts["present"], 883_612_800_000_000_000 // MONTH_NS + 1) if key != facts["present"] else (None, None)
        facts |= {
            "folds": own.select(F.floor(F.col("t_entry") / FOLD)).distinct().count(), "trades": m["n_trades"], "ci_lo": m["ci_lo"], "spa": bundle[key[1], "spa_against_nothing", None], "gain": gain, "gain_p": gain_p, "pbo": bundle[key[1], "pbo", None],
            "dsr": bundle.get((key[1], "deflated_sharpe", key[0])), "digests": {metrics_digest(t.repartition("t_entry", "l_linenumber")), metrics_digest(t.repartition("l_orderkey"))}, "unseen": unseen, "unseen_p": unseen_p}
    out = gate_checks(facts)
    passes = len(out) == 12 and all(ok for _, ok, _ in out)
    return spark.createDataFrame([(*r, passes) for r in out], "check string, ok boolean, detail string, passes boolean")


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as CSV, metrics as JSON and the log of two runs, written and read again."""
    root, t = shared_path(spark, "report"), trades(spark, sf_dir)
    results = written(metrics(t, BY))
    reports.write_trades(t, f"{root}/trades")
    reports.write_results(results, f"{root}/results")
    for run in ("first", "second"):
        reports.log_experiment(results, run, f"{root}/experiments")
    back = spark.read.schema(t.schema).option("header", True).csv(f"{root}/trades")
    rows = lambda df, name, x: df.agg(F.lit(name).alias("file"), F.count("*").alias("n"), R(F.sum(x), 6).alias("total"))
    out = rows(back, "trades", F.col("ret")).unionByName(rows(spark.read.schema(results.schema).json(f"{root}/results"), "results", F.col("n_trades").cast("double")))
    return out.unionByName(rows(reports.read_experiments(spark, f"{root}/experiments"), "experiments", F.col("n_trades").cast("double")))


REPORT = f"""WITH {TRADES}, g AS (SELECT {_BY}, count(*) AS n FROM tr GROUP BY ALL), s AS (SELECT count(*) AS n, CAST(sum(n) AS DOUBLE) AS t FROM g)
 SELECT 'trades' AS file, count(*) AS n, round(sum(ret), 6) AS total FROM tr UNION ALL SELECT 'results', n, t FROM s UNION ALL SELECT 'experiments', 2 * n, 2 * t FROM s"""

#: What positions have in common: their leverage, and the correlation of any two markets.
HELD_LEVERAGE, HELD_CORR = 5.0, 0.5


def position_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opens and closes of positions of the traded venue, as changes of what is held: symbol, ts, id, held, risk, notional."""
    q = quotes(spark, sf_dir).where((F.col("venue") == "lit") & (F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0))
    k, side = F.col("event_id"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    notional = 20.0 + k % 7 * 10
    p = q.select("symbol", "event_id", side.alias("side"), notional.alias("notional"), (0.003 + k % 4 / 1000).alias("sd"), (F.col("ts_local_ns") + 1).alias("t_open"), (F.col("ts_local_ns") + (k % 5 + 1) * HOUR).alias("t_close"))
    move = lambda sign, ts: p.select("symbol", F.col(ts).alias("ts"), (F.col("event_id") * 2 + int(sign < 0)).alias("id"), F.lit(sign).alias("held"), (F.col("side") * F.col("notional") * F.col("sd") * HELD_CORR * sign).alias("risk"), (F.col("notional") * sign).alias("notional"))
    return move(1, "t_open").unionByName(move(-1, "t_close"))


def opportunity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step, reason, execution and size of every quote of the traded venue taken as a signal, with the positions of its market and of the account as
    they stand then (F06, F09)."""
    c, k = F.col, F.col("event_id")
    delay = (c("ts_local_ns") - c("ts_exch_ns")) / 1e6
    q = quotes(spark, sf_dir).where("venue = 'lit'").withColumn("account", F.lit("a"))
    moves = written(position_moves(spark, sf_dir).withColumn("account", F.lit("a")))
    own = asof_scan(q, moves, ["symbol"], "ts_local_ns", "ts", {"held": ("sum", c("held"))}, DAY, "id")
    s = asof_scan(written(own), moves.drop("symbol"), ["account"], "ts_local_ns", "ts", {"held_risk": ("sum", c("risk")), "held_notional": ("sum", c("notional"))}, DAY, "id")
    s = s.withColumn("side", F.when(c("bid_sz") >= 5, 1).when(c("bid_sz") <= 2, -1).otherwise(0)).select(
        "event_id", "held", "held_risk", "held_notional", "side", (c("symbol") != "S7").alias("eligible"), (c("symbol") != "S6").alias("active"), (k % 97 == 0).alias("suspended"), ((c("bid_px") < c("ask_px")) & (c("bid_sz") > 1)).alias("usable"),
        (delay * 40).alias("lit_stale"), F.when(k % 50 != 0, delay * 20).alias("ref_stale"), c("ask_sz").alias("clock"), (c("bid_sz") / 1000).alias("mu"), (c("ask_sz") / 20000).alias("se"), F.lit(15.0).alias("horizon_s"),
        ((k % 7 - 3) / 1000).alias("funding_rate"), (k % 40).alias("funding_eta_s"), delay.alias("latency"), F.lit(45.0).alias("latency_cal"), F.when(k % 22 == 0, 9.0).otherwise(1000.0).alias("equity"), (0.004 + k % 3 / 1000).alias("sd"), (-0.004 - k % 4 / 1000).alias("es"),
        F.when(c("side") > 0, c("ask_px")).otherwise(c("bid_px")).alias("price"), F.lit(2).alias("decimals"), F.lit(0.05).alias("min_base"), F.lit(10.0).alias("min_quote"), F.lit(HELD_LEVERAGE).alias("market_leverage"), F.when(k % 62 == 0, 0.0).otherwise(1.0).alias("multiplier"),
        (c("held_notional") / HELD_LEVERAGE).alias("held_margin"), F.lit(0.6).alias("p_fill"), (c("bid_sz") / 800).alias("mu_passive"), (c("ask_sz") / 18000).alias("se_passive"), (c("bid_sz") - 3).alias("d_spread"), (c("ask_sz") - 5).alias("d_impact"), (k % 18).alias("capacity"))
    s = risk.cascade(s.fillna(0, ["held", "held_risk", "held_notional", "held_margin"]), stale_ms=3000.0, clock_ms=9.0, **LIMITS)
    return s.select("event_id", "step", "ok", "reason", "exec_mode", R("qty").alias("qty"), "leverage", R("mu_adj", 8).alias("mu_adj"), R("lcb", 8).alias("lcb"))


_CASCADE_CHOICE = f"mu - greatest(0, (bid_sz - 3) / 2 + ask_sz - 5) / 1e4 - {_D(_L['z'])} * se"
OPPORTUNITIES = f"""WITH {QUOTES}, p AS (SELECT symbol, event_id AS k, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS side, 20 + event_id % 7 * 10 AS nl, {_D(0.003)} + event_id % 4 / {_D(1000)} AS psd, ts_local_ns + 1 AS a, ts_local_ns + (event_id % 5 + 1) * {HOUR} AS b
  FROM quotes WHERE venue = 'lit' AND event_type = 'purchase' AND event_id % 5 = 0), mv AS (SELECT symbol, a AS ts, 1 AS held, side * nl * psd * {HELD_CORR} AS risk, nl FROM p UNION ALL SELECT symbol, b, -1, -side * nl * psd * {HELD_CORR}, -nl FROM p),
 ms AS (SELECT symbol, ts, sum(held) AS held FROM mv GROUP BY ALL), cs AS (SELECT symbol, ts, sum(held) OVER (PARTITION BY symbol ORDER BY ts) AS held FROM ms), ma AS (SELECT ts, sum(risk) AS risk, sum(nl) AS nl FROM mv GROUP BY ts), ca AS (SELECT ts, sum(risk) OVER (ORDER BY ts) AS risk, sum(nl) OVER (ORDER BY ts) AS nl FROM ma),
 s0 AS (SELECT q.*, coalesce(cs.held, 0) AS held FROM quotes q ASOF LEFT JOIN cs ON q.symbol = cs.symbol AND q.ts_local_ns >= cs.ts WHERE venue = 'lit'), s1 AS (SELECT s0.*, coalesce(ca.risk, 0) AS risk, coalesce(ca.nl, 0) AS nl FROM s0 ASOF LEFT JOIN ca ON s0.ts_local_ns >= ca.ts),
 s2 AS (SELECT *, event_id AS k, (ts_local_ns - ts_exch_ns) / 1e6 AS dl, CASE WHEN bid_sz >= 5 THEN 1 WHEN bid_sz <= 2 THEN -1 ELSE 0 END AS side, bid_sz / {_D(1000)} AS mu0, ask_sz / {_D(20000)} AS se, (CASE WHEN event_id % 22 = 0 THEN 9 ELSE 1000 END) - {_D(_L['reserve'])} AS e,
  {_D(0.004)} + event_id % 3 / {_D(1000)} AS sd, {_D(0.004)} + event_id % 4 / {_D(1000)} AS es, CASE WHEN event_id % 62 = 0 THEN 0 ELSE 1 END AS mult FROM s1),
 s3 AS (SELECT *, CASE WHEN k % 40 <= 15 + 2 * dl / 1000 THEN (k % 7 - 3) / {_D(1000)} * side ELSE 0 END AS fund, CASE WHEN side > 0 THEN ask_px ELSE bid_px END AS price FROM s2), s4 AS (SELECT *, mu0 - fund AS mu, mu0 - fund - {_D(_L['z'])} * se AS lcb, risk / e * sd * side AS cov FROM s3),
 o AS (SELECT *, (lcb - cov) / (sd * sd) AS opt, {_D(_L['gross_cap'])} - nl / e AS c2, ({_D(_L['margin_cap'])} - nl / {HELD_LEVERAGE} / e) * least({_D(HELD_LEVERAGE)}, ceil({_D(_L['gross_cap'])})) AS c3, {_D(_L['loss_share'])} / es AS c4, {_D(_L['max_notional'])} / e AS c5 FROM s4),
 z AS (SELECT *, least({_D(_L['position_cap'])}, c2, c3, c4, c5) AS cap FROM o),
 y AS (SELECT *, CASE WHEN e <= 0 THEN 'no_free_equity' WHEN mult <= 0 THEN 'risk_halt' WHEN NOT lcb > {_D(_L['min_lcb'])} THEN 'ev_lcb_not_positive' WHEN opt <= 0 THEN 'portfolio_correlation' WHEN cap <= 0 THEN
  CASE cap WHEN c2 THEN 'cap_gross_exhausted' WHEN c3 THEN 'cap_margin_exhausted' WHEN c4 THEN 'cap_loss_budget_exhausted' ELSE 'cap_validated_notional_exhausted' END END AS refused, least({_D(_L['kappa'])} * opt * mult, cap) AS f FROM z),
 x AS (SELECT *, CASE WHEN refused IS NULL THEN floor(CAST(f * e / price AS DECIMAL(28,10)) * 100) / 100 END AS raw, round(ceil(greatest({_D(0.05)}, 10 / price) / {_D(0.01)} - {_D(1e-9)}) * {_D(0.01)}, 10) AS qmin FROM y),
 w AS (SELECT *, raw + {_D(1e-12)} >= {_D(0.05)} AND raw * price + {_D(1e-9)} >= 10 AS feasible, qmin * price / e AS fmin FROM x), v AS (SELECT *, fmin <= cap AND fmin * lcb - 0.5 * fmin * fmin * sd * sd - fmin * cov > 0 AS lifted FROM w),
 u AS (SELECT *, coalesce(refused, CASE WHEN feasible THEN 'ok' WHEN lifted THEN 'raised_to_exchange_minimum' WHEN fmin > cap THEN 'below_exchange_minimum_cap' ELSE 'below_exchange_minimum_negative_growth' END) AS size_reason, CASE WHEN feasible THEN raw WHEN lifted THEN qmin END AS qty,
  {_CASCADE_CHOICE} AS ea, {_D(0.6)} * (bid_sz / {_D(800)} - fund - {_D(_L['z'])} * (ask_sz / {_D(18000)})) AS ep FROM v),
 t AS (SELECT *, CASE WHEN k % 18 < 2 THEN 'transaction_capacity' WHEN dl > 90 THEN 'latency_degraded' WHEN greatest(ea, ep) <= 0 THEN 'skip' WHEN ep > ea THEN 'passive' ELSE 'aggressive' END AS choice,
  CASE WHEN NOT (bid_px < ask_px AND bid_sz > 1) THEN 'book_unusable' WHEN dl * 40 > 3000 THEN 'lit_stale' WHEN k % 50 = 0 OR dl * 20 > 3000 THEN 'ref_stale' WHEN abs(dl * 40 - dl * 20) > 1500 THEN 'venue_skew' WHEN ask_sz > 9 THEN 'clock_uncertain' END AS data FROM u),
 r AS (SELECT *, CASE WHEN symbol IN ('S6', 'S7') OR k % 97 = 0 THEN 1 WHEN data IS NOT NULL THEN 2 WHEN side = 0 THEN 3 WHEN NOT lcb > {_D(_L['min_lcb'])} THEN 7 WHEN held > 0 THEN 8 WHEN size_reason NOT IN ('ok', 'raised_to_exchange_minimum') THEN 9 ELSE 10 END AS step FROM t)
 SELECT event_id, step, step = 10 AND choice IN ('aggressive', 'passive') AS ok, CASE step WHEN 1 THEN CASE WHEN symbol IN ('S6', 'S7') THEN 'instrument_ineligible' ELSE 'strategy_suspended' END WHEN 2 THEN data WHEN 3 THEN 'no_signal' WHEN 7 THEN 'lcb_below_margin' WHEN 8 THEN 'position_open' WHEN 9 THEN size_reason
  ELSE CASE WHEN choice IN ('aggressive', 'passive') THEN size_reason ELSE concat('execution_', choice) END END AS reason, CASE WHEN step = 10 AND choice IN ('aggressive', 'passive') THEN choice END AS exec_mode, CASE WHEN step = 10 AND choice IN ('aggressive', 'passive') THEN round(qty, 6) END AS qty,
 CASE WHEN step = 10 AND choice IN ('aggressive', 'passive') THEN least({_D(HELD_LEVERAGE)}, ceil({_D(_L['gross_cap'])})) END AS leverage, CASE WHEN step >= 7 THEN round(mu, 8) END AS mu_adj, CASE WHEN step >= 7 THEN round(lcb, 8) END AS lcb FROM r"""

QUERIES = {
    "opportunity_cascade": (opportunity_cascade, OPPORTUNITIES),
    "comparison_bundle": (comparison_bundle, None),
    "promotion_gate": (promotion_gate, None),
    "report_files": (report_files, REPORT),
    "trade_metrics": (trade_metrics, METRICS),
    "equity_metrics": (equity_metrics, EQUITY),
    "median_costs": (median_costs, COSTS),
    "position_ledger": (position_ledger, LEDGER),
    "walked_labels": (walked_labels, WALKED_SQL),
    "passive_outcome": (passive_outcome, PASSIVE_OUT),
    "passive_labels": (passive_labels, PASSIVE_LABELS),
    "policy_choice": (policy_choice, POLICY),
    "champion_choice": (champion_choice, CHAMPION),
    "prior_latency": (prior_latency, None),
    "unseen_comparison": (unseen_comparison, UNSEEN),
    "position_sizes": (position_sizes, SIZES),
}
