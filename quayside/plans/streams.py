"""Queries that run a streaming job over the files of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feeds import parse_lit_books
from ..sources.tables import shared_path
from ..sources.views import DAY, HOUR, QUOTES, quotes, table
from ..streaming import jobs
from ..streaming.landing import land, landed_messages
from ..streaming.ordered import landed, run_ordered
from .feeds import CONTINUITY, numbered, numbered_messages
from .labels import waiting_messages
from .market import HALFLIFE, MIDS, PAIRS, pair_returns


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.typed_events(jobs.stream_table(spark, sf_dir, "events"))


def stream_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(_typed(spark, sf_dir)).select("event_id", "venue", "symbol", "delay_ms")


def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    return jobs.run_once(jobs.health(_typed(spark, sf_dir))).select(F.unix_micros("start").alias("start_us"), "venue", "symbol", "messages", "max_delay")


# the watermark at the end is ten minutes before the last event; windows that end after it stay open
HEALTH = f"""WITH {QUOTES}, w AS (SELECT ts_local_ns // 21600000000000 * 21600000000 AS start_us, venue, symbol, count(*) AS messages, max((ts_local_ns - ts_exch_ns) // 1000000) AS max_delay FROM quotes GROUP BY ALL)
 SELECT * FROM w WHERE start_us + 21600000000 <= (SELECT max(ts_local_ns) // 1000 FROM quotes) - 600000000"""


def stream_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(jobs.silences(_typed(spark, sf_dir))).select("venue", "symbol", F.unix_micros("start").alias("start_us"), F.unix_micros("alarm").alias("alarm_us"), "messages")


# the watermark at the end is ten minutes before the last event; sessions that end after it stay open
SILENCES = f"""WITH {QUOTES}, q AS (SELECT venue, symbol, ts_local_ns // 1000 AS us FROM quotes), g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 10800000000 THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY venue, symbol ORDER BY us)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY venue, symbol ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g), s AS (SELECT venue, symbol, min(us) AS start_us, max(us) + 10800000000 AS alarm_us, count(*) AS messages FROM n GROUP BY venue, symbol, session)
 SELECT * FROM s WHERE alarm_us <= (SELECT max(us) FROM q) - 600000000"""


def stream_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rolled up from fills that may come twice."""
    t = jobs.stream_table(spark, sf_dir, "lineitem")
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    fills = t.select(
        F.col("l_orderkey").alias("order_id"), name.alias("trade_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"))
    twice = fills.withColumn("copy", F.explode(F.when(F.crc32("trade_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    return jobs.fill_ledger(twice).select("order_id", "fills", F.round("qty", 4).alias("qty"), F.round(F.col("notional") / F.col("qty"), 9).alias("avg_px"), F.round("fees", 6).alias("fees"))


STREAM_FILLS = """WITH o AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax FROM lineitem)
 SELECT l_orderkey AS order_id, CAST(count(*) AS BIGINT) AS fills, round(sum(l_quantity), 4) AS qty, round(sum(l_quantity * (l_extendedprice / l_quantity)) / sum(l_quantity), 9) AS avg_px, round(sum(l_extendedprice * l_tax), 6) AS fees FROM o GROUP BY l_orderkey"""


def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = quotes(spark, sf_dir).groupBy("symbol").agg(F.lit(40.0).alias("latency"))
    return jobs.run_once(jobs.annotated(_typed(spark, sf_dir), policy)).select("event_id", "symbol", "choice")


SIGNALS = f"""WITH {QUOTES}, d AS (SELECT *, (ts_local_ns - ts_exch_ns) // 1000000 AS dl, value / 1e5 - CAST(1.645 AS DOUBLE) * CAST(0.001 AS DOUBLE) AS a, CAST(0.6 AS DOUBLE) * (value / 9e4 - CAST(1.645 AS DOUBLE) * CAST(0.001 AS DOUBLE)) AS p FROM quotes)
 SELECT event_id, symbol, CASE WHEN dl > 80 THEN 'latency_degraded' WHEN greatest(a, p) <= 0 THEN 'skip' WHEN p > a THEN 'passive' ELSE 'aggressive' END AS choice FROM d"""


def edge_trades(t: DataFrame) -> DataFrame:
    return t.select(
        F.concat("l_returnflag", "l_linestatus").alias("strategy"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        ((F.col("l_discount") - 0.05) + (F.col("l_tax") - 0.04) / 10).alias("ret"), F.lit(-0.01).alias("lcb"))


def stream_edge_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of each strategy's monitor over all its trades."""
    trades = landed(jobs.trade_blocks(edge_trades(table(spark, sf_dir, "lineitem"))), "ts")
    seen = run_ordered(jobs.edge_monitor_blocks(trades, width="40 days"))
    last = seen.groupBy("strategy").agg(F.max_by(F.struct("multiplier", "reductions", "status"), "n").alias("s"), F.max("n").alias("n"))
    return last.select("strategy", "n", "s.*")


def stream_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuity check as a stateful stream; the batch twin is ``sequence_gaps``."""
    m = numbered_messages(numbered(spark, sf_dir)).withColumn("ts_us", F.expr("ts_local_ns DIV 1000"))
    return run_ordered(jobs.sequence_monitor(landed(m.select("venue", "symbol", "ts_us", "event_id", "snapshot", "begin", "nonce"), "ts_us"), width="2 days"))


SEQUENCE = f"WITH {QUOTES}, m AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id) AS n FROM quotes), {CONTINUITY}"


def stream_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth synchronisation as a stateful stream; numbers follow the event ids of a stream, some updates come twice."""
    e = table(spark, sf_dir, "events")
    n, snap = F.col("event_id") * 10, F.col("event_type") == "signup"
    last = F.when(snap, n + 15).when(F.col("event_id") % 7 == 0, n - 160).otherwise(n)
    m = e.select(
        F.lit("ref").alias("venue"), (F.col("event_id") % 16).cast("string").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id", snap.alias("snapshot"), (last - 159).alias("first_id"), last.alias("last_id"),
        (last - F.when(F.col("event_id") % 13 == 0, 161).when((F.col("event_id") - 16) % 7 == 0, 320).otherwise(160)).alias("prev_id"))
    log = run_ordered(jobs.depth_monitor(landed(m, "ts_us"), width="2 days"))
    return log.groupBy("event_id").agg(F.min_by("state", "at_us").alias("state"))


DEPTH = """WITH m AS (SELECT event_id, event_id % 16 AS k, event_type = 'signup' AS snap, CASE WHEN event_type = 'signup' THEN event_id * 10 + 15 WHEN event_id % 7 = 0 THEN event_id * 10 - 160 ELSE event_id * 10 END AS u,
  CASE WHEN event_id % 13 = 0 THEN 161 WHEN (event_id - 16) % 7 = 0 THEN 320 ELSE 160 END AS back FROM events),
 e AS (SELECT *, sum(CASE WHEN snap THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM m), b AS (SELECT *, max(CASE WHEN snap THEN u END) OVER (PARTITION BY k, epoch) AS base FROM e),
 s AS (SELECT *, greatest(base, max(CASE WHEN NOT snap THEN u END) OVER w) AS last, coalesce(max(CASE WHEN NOT snap AND u >= base THEN 1 END) OVER w, 0) = 1 AS bridged FROM b WINDOW w AS (PARTITION BY k, epoch ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 o AS (SELECT *, NOT snap AND epoch > 0 AND CASE WHEN bridged THEN u <= last ELSE u < base END AS old FROM s),
 q AS (SELECT *, max(CASE WHEN NOT snap AND epoch > 0 AND NOT old AND NOT CASE WHEN bridged THEN u - back = last ELSE u - 159 <= base + 1 END THEN 1 ELSE 0 END) OVER (PARTITION BY k, epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS broken FROM o)
 SELECT event_id, CASE WHEN snap THEN 'snapshot' WHEN epoch = 0 OR broken = 1 THEN 'gap' WHEN old THEN 'old' ELSE 'delta' END AS state FROM q"""


def stream_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synchronisation with buffered release as a stream (X02, X10); the batch twin is ``depth_release``."""
    m = waiting_messages(spark, sf_dir).withColumn("ts_us", F.expr("ts_local_ns DIV 1000")).select("venue", "symbol", "ts_us", "event_id", "snapshot", "first_id", "last_id", "prev_id")
    last = jobs.outcomes(run_ordered(jobs.depth_monitor(landed(m, "ts_us"), width="6 hours")))
    return last.select("event_id", "state", F.when(F.col("state") != "gap", F.col("at_us") * 1000).alias("at"))


def stream_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid samples of a live run; the batch twin is ``asof_grid_state``."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    base = F.round(100 + F.col("value") / 100, 2)
    mid = (F.round(base - 0.01 * (k % 5 + 1), 2) + F.round(base + 0.01 * (k % 5 + 1), 2)) / 2
    traded = lambda side: F.when((F.col("event_type") == "purchase") & (F.expr("event_id DIV 2") % 2 == side), (k % 11 + 1).cast("double")).otherwise(0.0)
    q = e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), F.when(F.col("event_id") % 2 == 0, "lit").otherwise("ref").alias("venue"), "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), mid.alias("mid"), traded(0).alias("buy"), traded(1).alias("sell"))
    out = run_ordered(jobs.grid_samples(landed(q, "ts_us"), HOUR // 1000, width="2 days"))
    known = lambda c: F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(c)
    return out.select("symbol", (F.col("tick_us") * 1000).alias("ts_ns"), known("lit_mid"), known("ref_mid"), "buy", "sell", "trades")


STREAM_GRID = f"""WITH {MIDS}, t AS (SELECT symbol, ts_local_ns, sum(CASE WHEN event_id // 2 % 2 = 0 THEN ask_sz ELSE 0 END) AS b, sum(CASE WHEN event_id // 2 % 2 = 1 THEN ask_sz ELSE 0 END) AS s, count(*) AS n FROM quotes WHERE venue = 'lit' AND event_type = 'purchase' GROUP BY ALL),
 c AS (SELECT symbol, ts_local_ns, sum(b) OVER w AS b, sum(s) OVER w AS s, sum(n) OVER w AS n FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_local_ns))
 SELECT m.symbol, m.ts_ns, round(lit_mid, 6) AS lit_mid, round(ref_mid, 6) AS ref_mid, coalesce(b, CAST(0 AS DOUBLE)) AS buy, coalesce(s, CAST(0 AS DOUBLE)) AS sell, CAST(coalesce(n, 0) AS BIGINT) AS trades FROM mids m ASOF LEFT JOIN c ON m.symbol = c.symbol AND m.ts_ns >= c.ts_local_ns"""


def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair tracker over landed returns of the grid; the batch twin is ``pair_correlation``."""
    returns = pair_returns(spark, sf_dir).select((F.col("tick") * (HOUR // 1000)).alias("tick"), "a", "b", "ra", "rb")
    seen = run_ordered(jobs.pair_tracker(landed(returns, "tick"), HALFLIFE, width="8 days"))
    last = seen.groupBy("a", "b").agg(F.max_by("corr", "n").alias("corr"), F.max("n").alias("n"))
    return last.select("a", "b", "n", F.round("corr", 6).alias("corr"))


def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book messages landed as raw lines by venue, day and hour, and parsed from there by a second stream."""
    root = shared_path(spark, "landing")
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit('{"type":"update/order_book","channel":"order_book:'), (F.col("user_id") % 8).cast("string"), F.lit('","order_book":\n{"bids":[["1.5","'), k, F.lit('"]],"asks":[],"nonce":'), F.col("event_id").cast("string"), F.lit("}}"))
    feed = jobs.stream_table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 2 == 0, "lit").otherwise("ref").alias("venue"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("conn_id"), raw.alias("raw"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("at"))
    land(feed, f"{root}/raw", f"{root}/state", "at").awaitTermination()
    rows = jobs.run_once(parse_lit_books(landed_messages(spark, f"{root}/raw", 10_000)))
    return rows.select("venue", "day", "hour", "ts_local_ns", "conn_id", "kind", "market_id", F.col("bids")[0]["size"].alias("bid_sz"), "nonce")


LANDING = """SELECT CASE WHEN event_id % 2 = 0 THEN 'lit' ELSE 'ref' END AS venue, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%H') AS hour, epoch_us(ts) * 1000 AS ts_local_ns, concat('c', user_id % 3) AS conn_id, 'delta' AS kind, CAST(user_id % 8 AS INTEGER) AS market_id,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS bid_sz, event_id AS nonce FROM events"""

QUERIES = {
    "stream_landing": (stream_landing, LANDING),
    "stream_typed": (stream_typed, f"WITH {QUOTES} SELECT event_id, venue, symbol, (ts_local_ns - ts_exch_ns) // 1000000 AS delay_ms FROM quotes"),
    "stream_health": (stream_health, HEALTH),
    "stream_silences": (stream_silences, SILENCES),
    "stream_fills": (stream_fills, STREAM_FILLS),
    "stream_signals": (stream_signals, SIGNALS),
    "stream_edge_monitor": (stream_edge_monitor, None),
    "stream_sequence": (stream_sequence, SEQUENCE),
    "stream_depth": (stream_depth, DEPTH),
    "stream_release": (stream_release, None),
    "stream_grid": (stream_grid, STREAM_GRID),
    "stream_pairs": (stream_pairs, PAIRS),
}
