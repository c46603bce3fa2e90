"""Queries over raw messages, sequences and stream quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scans import prefix_scan
from ..operators import feeds
from ..sources.views import DAY, QUOTES, quotes

KIND = "CASE event_type WHEN 'purchase' THEN 'trade' WHEN 'error' THEN 'gap' WHEN 'signup' THEN 'disconnect' ELSE 'update' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as events; every third disconnect is one of the whole venue."""
    whole = (F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)
    return quotes(spark, sf_dir).withColumn("kind", F.expr(KIND)).withColumn("symbol", F.when(whole, "*").otherwise(F.col("symbol")))


def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01-A04."""
    return feeds.stream_quality(_events(spark, sf_dir))


QUALITY = f"""WITH {QUOTES}, e AS (SELECT *, {KIND} AS kind, event_type = 'signup' AND event_id % 3 = 0 AS whole FROM quotes), s AS (SELECT *, (ts_local_ns - lag(ts_local_ns) OVER w) / 1e6 AS silence,
 max(CASE WHEN kind = 'update' THEN ts_exch_ns END) OVER (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id ROWS UNBOUNDED PRECEDING) AS mx FROM e WHERE kind IN ('trade', 'update') WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id)),
 v AS (SELECT venue, count(*) AS n FROM e WHERE whole GROUP BY venue), c AS (SELECT venue, symbol, count(*) FILTER (kind = 'gap') AS gaps, count(*) FILTER (kind = 'disconnect' AND NOT whole) AS own FROM e GROUP BY venue, symbol)
 SELECT venue, symbol, count(*) AS messages, count(*) FILTER (kind = 'trade') AS trades, count(*) FILTER (kind = 'update') AS updates, any_value(c.gaps) AS gaps, any_value(c.own) + coalesce(any_value(v.n), 0) AS disconnects,
 round((max(ts_local_ns) - min(ts_local_ns)) / 3.6e12, 6) AS span_hours, round(max(silence), 3) AS max_silence_ms, count(*) FILTER (kind = 'update' AND ts_exch_ns < mx) AS regressions FROM s JOIN c USING (venue, symbol) LEFT JOIN v USING (venue) GROUP BY venue, symbol"""

#: Messages of a stream that its delay quantiles look at.
LAST = 20_000


def delay_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05."""
    return feeds.delay_quantiles(quotes(spark, sf_dir), LAST)


DELAYS = f"""WITH {QUOTES}, n AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY ts_local_ns DESC, event_id DESC) AS n, (ts_local_ns - ts_exch_ns) / 1e6 AS d FROM quotes)
 SELECT venue, symbol, round(quantile_cont(d, 0.5), 4) AS p50, round(quantile_cont(d, 0.95), 4) AS p95, round(quantile_cont(d, 0.99), 4) AS p99 FROM n WHERE n <= {LAST} GROUP BY venue, symbol"""


def merged_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily reports merged."""
    d = (F.col("ts_local_ns") - F.col("ts_exch_ns")) / 1e6
    daily = quotes(spark, sf_dir).groupBy("venue", "symbol", F.floor(F.col("ts_local_ns") / DAY).alias("day")).agg(F.count("*").alias("messages"), F.max(d).alias("max_delay"), F.percentile(d, F.lit(0.5)).alias("p50"))
    return feeds.merge_quality(daily)


MERGED = f"""WITH {QUOTES}, d AS (SELECT venue, symbol, ts_local_ns // {DAY} AS day, count(*) AS m, max((ts_local_ns - ts_exch_ns) / 1e6) AS mx, quantile_cont((ts_local_ns - ts_exch_ns) / 1e6, 0.5) AS p FROM quotes GROUP BY ALL)
 SELECT venue, symbol, CAST(sum(m) AS BIGINT) AS messages, max(mx) AS max_delay, round(sum(p * m) / sum(m), 6) AS p50 FROM d GROUP BY venue, symbol"""


def data_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last arrival by venue, and whether any session was synthetic."""
    session = F.when(F.col("event_type") == "signup", F.col("event_id") % 97 == 0)  # other messages carry no session
    return quotes(spark, sf_dir).groupBy("venue").agg(F.min("ts_local_ns").alias("first_ns"), F.max("ts_local_ns").alias("last_ns"), F.max(F.coalesce(session, F.lit(False))).alias("synthetic"))


def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours, rows, valid share and symbols of the data."""
    q = quotes(spark, sf_dir)
    return q.agg(F.round((F.max("ts_local_ns") - F.min("ts_local_ns")) / 3.6e12, 6).alias("hours"), F.count("*").alias("n_rows"), F.round(F.avg((F.col("bid_sz") > 1).cast("int")), 6).alias("valid_share"), F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"))


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines split into parts, torn lines dropped, time range kept."""
    t = F.col("ts_local_ns").cast("string")
    line = F.when(F.col("event_id") % 97 == 0, F.concat_ws("\t", t, F.lit("torn"))).otherwise(F.concat_ws("\t", t, t, "venue", F.concat(F.lit("a\tb "), F.col("event_id").cast("string"))))
    rows = feeds.split_lines(quotes(spark, sf_dir).select(line.alias("value")))
    return rows.where(F.col("ts_local_ns") >= 1704412800000000000).select("ts_local_ns", "conn_id", "raw")


RAW = f"WITH {QUOTES} SELECT ts_local_ns, venue AS conn_id, concat('a', chr(9), 'b ', event_id) AS raw FROM quotes WHERE event_id % 97 <> 0 AND ts_local_ns >= 1704412800000000000"


def ts_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in four units come back as nanoseconds."""
    q = quotes(spark, sf_dir)
    scale = F.when(F.col("event_id") % 4 == 0, 1).when(F.col("event_id") % 4 == 1, 1000).when(F.col("event_id") % 4 == 2, 1_000_000).otherwise(1_000_000_000).cast("long")
    q = q.withColumn("scale", scale).withColumn("x", F.expr("CASE WHEN event_id % 101 = 0 THEN 0 ELSE ts_local_ns DIV scale END"))
    return q.select("event_id", feeds.to_ns("x").alias("ns"))


UNITS = f"""WITH {QUOTES} SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 0 ELSE ts_local_ns // s * s END AS ns FROM (SELECT *, CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END AS BIGINT) AS s FROM quotes)"""


def parse_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book messages as JSON and back: kind, market, levels."""
    px = lambda c, d: F.format_string(f'{{"price":"%s","size":"%s"}}', F.col(c).cast("string"), F.col(d).cast("string"))  # noqa: E731, F541
    raw = F.concat(
        F.lit('{"type":"'), F.when(F.col("event_type") == "signup", "subscribed/order_book").otherwise("update/order_book"), F.lit('","channel":"order_book'), F.when(F.col("event_id") % 2 == 0, ":").otherwise("/"), F.substring("symbol", 2, 3),
        F.lit('","order_book":{"bids":['), px("bid_px", "bid_sz"), F.lit('],"asks":['), px("ask_px", "ask_sz"), F.lit('],"nonce":'), F.col("event_id").cast("string"), F.lit("}}"))
    out = feeds.parse_lit_books(quotes(spark, sf_dir).select("event_id", raw.alias("raw")))
    return out.select("event_id", "kind", "market_id", F.col("bids")[0]["price"].alias("bid_px"), F.col("bids")[0]["size"].alias("bid_sz"), F.col("asks")[0]["price"].alias("ask_px"), "nonce")


BOOKS = f"WITH {QUOTES} SELECT event_id, CASE WHEN event_type = 'signup' THEN 'snapshot' ELSE 'delta' END AS kind, CAST(substr(symbol, 2) AS INTEGER) AS market_id, bid_px, bid_sz, ask_px, event_id AS nonce FROM quotes"


def parse_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of two trades each, one row a trade, with taker side and own side."""
    one = lambda k, maker, bid: F.concat(
        F.lit(f'{{"trade_id":"{k}-'), F.col("event_id").cast("string"), F.lit('","price":"'), F.col("bid_px").cast("string"), F.lit('","size":"'), F.col("bid_sz").cast("string"),
        F.lit(f'","is_maker_ask":{maker},"bid_account_id":'), F.lit(bid), F.lit(',"ask_account_id":'), (F.col("event_id") % 10).cast("string"), F.lit("}"))
    raw = F.concat(F.lit('{"type":"update/trade","channel":"trade:'), F.substring("symbol", 2, 3), F.lit('","trades":['), one(1, "true", "7"), F.lit(","), one(2, "false", "8"), F.lit("]}"))
    return feeds.parse_lit_trades(quotes(spark, sf_dir).select(raw.alias("raw")), 7)


TRADES = f"""WITH {QUOTES} SELECT CAST(substr(symbol, 2) AS INTEGER) AS market_id, concat(k, '-', event_id) AS trade_id, bid_px AS price, bid_sz AS size, CASE WHEN k = 1 THEN 1 ELSE -1 END AS taker_side,
 CASE WHEN k = 1 THEN 1 WHEN event_id % 10 = 7 THEN -1 ELSE 0 END AS own_side FROM quotes, (SELECT unnest([1, 2]) AS k)"""


def parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market statistics as one object or a map of objects."""
    obj = lambda i, name: F.concat(F.lit('{"market_id":'), (F.col("event_id") % 8 + i).cast("string"), F.lit(',"mark_price":"'), F.col("ask_px").cast("string"), F.lit(f'","{name}":"'), F.col("bid_sz").cast("string"), F.lit('"}'))
    single, many = obj(0, "current_funding_rate"), F.concat(F.lit('{"0":'), obj(0, "funding_rate"), F.lit(',"1":'), obj(100, "funding_rate"), F.lit("}"))
    raw = F.concat(F.lit('{"type":"update/market_stats","channel":"market_stats:0","market_stats":'), F.when(F.col("event_id") % 2 == 0, single).otherwise(many), F.lit("}"))
    out = feeds.parse_lit_stats(quotes(spark, sf_dir).select("event_id", raw.alias("raw")))
    return out.select("event_id", "market_id", "mark_price", F.round("funding_rate", 8).alias("funding_rate"))


STATS = f"""WITH {QUOTES} SELECT event_id, CAST(event_id % 8 + i AS INTEGER) AS market_id, ask_px AS mark_price, round(bid_sz / 100, 8) AS funding_rate FROM quotes, (SELECT unnest([0, 100]) AS i) WHERE i = 0 OR event_id % 2 = 1"""


def parse_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touch, trade and funding messages of the reference venue."""
    c = lambda x: F.col(x).cast("string")
    bbo = F.concat(F.lit('{"e":"bookTicker","s":"1000s'), F.substring("symbol", 2, 3), F.lit('","b":"'), c("bid_px"), F.lit('","B":"'), c("bid_sz"), F.lit('","a":"'), c("ask_px"), F.lit('","A":"'), c("ask_sz"), F.lit('"}'))
    trade = F.concat(F.lit('{"e":"aggTrade","s":"1000s'), F.substring("symbol", 2, 3), F.lit('","p":"'), c("bid_px"), F.lit('","q":"'), c("bid_sz"), F.lit('","m":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))
    mark = F.concat(F.lit('{"e":"markPriceUpdate","s":"1000s'), F.substring("symbol", 2, 3), F.lit('","p":"'), c("ask_px"), F.lit('","r":"'), c("bid_sz"), F.lit('"}'))
    raw = F.concat(F.lit('{"stream":"x","data":'), F.when(F.col("event_type") == "purchase", trade).when(F.col("event_type") == "click", mark).otherwise(bbo), F.lit("}"))
    rows = feeds.parse_ref(quotes(spark, sf_dir).select("event_id", raw.alias("raw")))
    mapping = spark.createDataFrame([(f"1000S{i}", f"S{i}", 0.001) for i in range(7)], "venue_symbol string, symbol string, multiplier double")
    out = feeds.canonical_symbols(rows, mapping, ["px", "ask_px"], ["sz", "ask_sz"])
    return out.select("event_id", "kind", "symbol", F.round("px", 8).alias("px"), F.round("sz", 4).alias("sz"), F.round("ask_px", 8).alias("ask_px"), "taker_side", "funding_rate")


REFERENCE = f"""WITH {QUOTES}, k AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'trade' WHEN 'click' THEN 'stats' ELSE 'bbo' END AS kind FROM quotes) SELECT event_id, kind, symbol, round((CASE WHEN kind = 'stats' THEN ask_px ELSE bid_px END) * CAST(0.001 AS DOUBLE), 8) AS px, CASE WHEN kind <> 'stats' THEN round(bid_sz / CAST(0.001 AS DOUBLE), 4) END AS sz,
 CASE WHEN kind = 'bbo' THEN round(ask_px * CAST(0.001 AS DOUBLE), 8) END AS ask_px, CASE WHEN kind = 'trade' THEN CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END END AS taker_side, CASE WHEN kind = 'stats' THEN bid_sz END AS funding_rate FROM k WHERE symbol <> 'S7'"""


def feed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed markers among messages, as statuses of all streams of the venue."""
    raw = F.when(F.col("event_type") == "error", F.lit('{"type":"_feed/disconnected","detail":"x"}')).when(F.col("event_type") == "signup", F.lit('{"stream":"_feed/connected","data":{}}')).otherwise(F.lit('{"type":"update/order_book","detail":"........................ _feed/disconnected"}'))
    q = quotes(spark, sf_dir)
    return feeds.fan_out(feeds.feed_status(q.select("event_id", "venue", raw.alias("raw"))), q).select("event_id", "venue", "symbol", "status")


MARKERS = f"WITH {QUOTES} SELECT event_id, venue, s.symbol, CASE WHEN event_type = 'error' THEN 'disconnected' ELSE 'connected' END AS status FROM quotes JOIN (SELECT DISTINCT venue, symbol FROM quotes) s USING (venue) WHERE event_type IN ('error', 'signup')"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with ``n``, their place in the stream from 1."""
    return prefix_scan(quotes(spark, sf_dir), ["venue", "symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY), {"n": ("count", F.lit(1))})


def numbered_messages(m: DataFrame) -> DataFrame:
    """``m`` (event_id, event_type, n) with snapshot, begin and nonce: breaks, deltas without nonce or beginning, a beginning of 0, a snapshot of 0."""
    i, snapshot = F.col("event_id"), F.col("event_type") == "signup"
    nonce = F.when(snapshot & (i % 5 == 0), 0).when(~snapshot & (i % 9 == 0), 0).otherwise(F.col("n"))
    begin = F.when(i % 11 == 0, F.col("n") - 2).when(i % 37 == 0, 0).when(i % 3 == 0, None).otherwise(F.col("n") - 1)
    return m.withColumn("snapshot", snapshot).withColumn("nonce", nonce.cast("long")).withColumn("begin", begin.cast("long"))


def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity of numbered messages with snapshots and breaks."""
    m = numbered_messages(numbered(spark, sf_dir))
    return feeds.continuity(m, ["venue", "symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY)).select("event_id", "state")


#: States of numbered messages ``m`` (venue, symbol, event_id, event_type, n: the place in the stream).
CONTINUITY = """s AS (SELECT *, event_type = 'signup' AS snap, CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 0 WHEN event_type <> 'signup' AND event_id % 9 = 0 THEN 0 ELSE n END AS nonce,
  CASE WHEN event_id % 11 = 0 THEN n - 2 WHEN event_id % 37 = 0 THEN 0 WHEN event_id % 3 = 0 THEN NULL ELSE n - 1 END AS begins FROM m),
 l AS (SELECT *, last_value(CASE WHEN snap OR nonce <> 0 THEN nonce END IGNORE NULLS) OVER (PARTITION BY venue, symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s),
 k AS (SELECT *, last_value(CASE WHEN snap THEN 0 WHEN nonce <> 0 AND begins <> last THEN 1 END IGNORE NULLS) OVER (PARTITION BY venue, symbol ORDER BY n ROWS UNBOUNDED PRECEDING) AS mark FROM l)
 SELECT event_id, CASE WHEN snap THEN 'snapshot' WHEN mark = 0 THEN 'delta' ELSE 'gap' END AS state FROM k"""
GAPS = f"WITH {QUOTES}, m AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id) AS n FROM quotes), {CONTINUITY}"


def depth_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridging and chaining of depth updates after a snapshot, some of them sent twice."""
    n = F.col("n") * 10
    m = numbered(spark, sf_dir).withColumn("snapshot", F.col("event_type") == "signup")
    # an update of each seventh number repeats the one before it
    m = m.withColumn("last_id", F.when(F.col("snapshot"), n + 15).when(F.col("n") % 7 == 0, n - 10).otherwise(n))
    m = m.withColumn("first_id", F.col("last_id") - 9).withColumn("prev_id", F.col("last_id") - F.when(F.col("event_id") % 13 == 0, 11).when(F.col("n") % 7 == 1, 20).otherwise(10))
    return feeds.depth_sync(m, ["venue", "symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY)).select("event_id", "state")


SYNC = f"""WITH {QUOTES}, m AS (SELECT *, row_number() OVER w AS n, event_type = 'signup' AS snap, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM quotes WINDOW w AS (PARTITION BY venue, symbol ORDER BY ts_local_ns, event_id)),
 u AS (SELECT *, CASE WHEN snap THEN n * 10 + 15 WHEN n % 7 = 0 THEN n * 10 - 10 ELSE n * 10 END AS u FROM m), k AS (SELECT *, u - (CASE WHEN event_id % 13 = 0 THEN 11 WHEN n % 7 = 1 THEN 20 ELSE 10 END) AS pu, max(CASE WHEN snap THEN u END) OVER (PARTITION BY venue, symbol, epoch) AS base FROM u),
 s AS (SELECT *, max(CASE WHEN NOT snap THEN u END) OVER e AS seen, coalesce(max(CASE WHEN NOT snap AND u >= base THEN 1 END) OVER e, 0) = 1 AS bridged FROM k WINDOW e AS (PARTITION BY venue, symbol, epoch ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 o AS (SELECT *, NOT snap AND epoch > 0 AND CASE WHEN bridged THEN u <= greatest(seen, base) ELSE u < base END AS old FROM s),
 q AS (SELECT *, max(CASE WHEN NOT snap AND epoch > 0 AND NOT old AND NOT (CASE WHEN bridged THEN pu = greatest(seen, base) ELSE u - 9 <= base + 1 END) THEN 1 ELSE 0 END) OVER (PARTITION BY venue, symbol, epoch ORDER BY n ROWS UNBOUNDED PRECEDING) AS broken FROM o)
 SELECT event_id, CASE WHEN snap THEN 'snapshot' WHEN epoch = 0 OR broken = 1 THEN 'gap' WHEN old THEN 'old' ELSE 'delta' END AS state FROM q"""

QUERIES = {
    "stream_quality": (stream_quality, QUALITY),
    "delay_quantiles": (delay_quantiles, DELAYS),
    "merged_quality": (merged_quality, MERGED),
    "data_span": (data_span, f"WITH {QUOTES} SELECT venue, min(ts_local_ns) AS first_ns, max(ts_local_ns) AS last_ns, bool_or(event_type = 'signup' AND event_id % 97 = 0) AS synthetic FROM quotes GROUP BY venue"),
    "period_summary": (period_summary, f"WITH {QUOTES} SELECT round((max(ts_local_ns) - min(ts_local_ns)) / 3.6e12, 6) AS hours, count(*) AS n_rows, round(avg(CASE WHEN bid_sz > 1 THEN 1 ELSE 0 END), 6) AS valid_share, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols FROM quotes"),
    "raw_scan": (raw_scan, RAW),
    "ts_unit_inference": (ts_units, UNITS),
    "parse_books": (parse_books, BOOKS),
    "parse_trades_explode": (parse_trades, TRADES),
    "parse_stats_map": (parse_stats, STATS),
    "parse_reference": (parse_reference, REFERENCE),
    "feed_markers": (feed_markers, MARKERS),
    "sequence_gaps": (sequence_gaps, GAPS),
    "depth_sync": (depth_sync, SYNC),
}
