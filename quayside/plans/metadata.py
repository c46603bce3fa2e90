"""Queries over metadata that lies beside the raw messages, and the replay of messages with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feeds, meta, schema
from ..sources.tables import shared_path
from ..sources.views import DAY, HOUR, QUOTES, quotes, table
from .market import LEAD_LAG, MIDS, lead_lag_features

T0 = 1_704_067_200_000_000_000
#: When the second mapping comes into force.
T1 = T0 + 15 * DAY


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of all kinds as raw lines: markets from ``part``, 50 a message, executions from ``orders`` and ``lineitem``,
    clock probes and sessions from ``events``."""
    text = lambda c: F.col(c).cast("string")
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    market = F.struct(
        k.cast("int").alias("market_id"), F.concat(F.lit("P"), text("p_partkey")).alias("symbol"), F.when(F.col("p_size") > 5, "active").otherwise("inactive").alias("status"),
        F.when(k % 9 == 0, "spot").when(k % 4 == 0, "PERP").alias("market_type"), F.when(k % 5 != 0, (F.col("p_size") / 1000).cast("string")).alias("taker_fee"), F.lit("0.01").alias("maker_fee"),
        (k % 3).cast("string").alias("min_base_amount"), F.lit("10").alias("min_quote_amount"), F.when(k % 2 == 0, (F.col("p_size") % 4)).alias("size_decimals"), F.when(k % 6 == 1, F.lit(1)).alias("supported_size_decimals"),
        F.when(k % 8 != 0, text("p_size")).alias("default_initial_margin_fraction"), text("p_retailprice").alias("last_trade_price"))
    markets = p.groupBy(F.expr("p_partkey DIV 50").alias("g")).agg(F.sort_array(F.collect_list(market)).alias("list")).withColumn("ts_ns", F.lit(T0) + F.col("g") * HOUR)
    lines = meta.meta_lines(markets, "lighter_markets", F.struct(F.col("list").alias("order_book_details")))
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", ns("o_orderdate").alias("ts_ns"))
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(ns("l_shipdate")).alias("print"))
    x = o.join(first, "o_orderkey", "left")
    record = F.struct(
        F.when(F.col("o_orderstatus") == "O", "taker").otherwise("maker").alias("kind"), F.col("ts_ns").alias("t_decision"), (F.col("ts_ns") + 1000).alias("t_sent"), (F.col("ts_ns") + 5000).alias("t_ack"),
        F.col("print").alias("t_fill_print"), F.concat(F.lit("S"), (F.col("o_orderkey") % 8).cast("string")).alias("symbol"), F.lit("live").alias("mode"))
    lines = lines.unionByName(meta.meta_lines(x, "exec", record))
    q = quotes(spark, sf_dir).withColumn("ts_ns", F.col("ts_local_ns"))
    probe = F.struct("venue", (F.col("ts_ns") - 2_000_000).alias("send_ns"), F.col("ts_ns").alias("recv_ns"), F.col("ts_exch_ns").alias("server_ns"))
    lines = lines.unionByName(meta.meta_lines(q.where("event_type = 'click'"), "clock_probe", probe))
    return lines.unionByName(meta.meta_lines(q.where("event_type = 'signup'"), "session", F.struct((F.col("event_id") % 97 == 0).alias("synthetic"), F.lit("1").alias("version"))))


def market_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market rows of metadata written to raw files and read from there."""
    path, lines = shared_path(spark), _lines(spark, sf_dir)
    feeds.write_raw(lines.where(F.get_json_object("raw", "$.type") == "lighter_markets"), path, sparse=True)
    return meta.market_details(feeds.read_raw(spark, path, ["meta"]))


_MARKETS = f"""mk AS (SELECT {T0} + p_partkey // 50 * {HOUR} AS ts_ns, CAST(p_partkey AS INTEGER) AS market_id, concat('P', p_partkey) AS symbol, CASE WHEN p_size > 5 THEN 'active' ELSE 'inactive' END AS status,
 CASE WHEN p_partkey % 5 <> 0 THEN p_size / 1000 / 100 ELSE 0 END AS taker_fee, CAST(0.01 AS DOUBLE) / 100 AS maker_fee, CAST(p_partkey % 3 AS DOUBLE) AS min_base, CAST(10 AS DOUBLE) AS min_quote,
 CASE WHEN p_partkey % 2 = 0 THEN p_size % 4 WHEN p_partkey % 6 = 1 THEN 1 ELSE 4 END AS size_decimals, 2 AS price_decimals, CASE WHEN p_partkey % 8 <> 0 THEN p_size / CAST(10000 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS default_imf,
 CAST(0.1 AS DOUBLE) AS min_imf, CAST(0.05 AS DOUBLE) AS mmf, p_retailprice AS last_price, CAST(0 AS DOUBLE) AS volume FROM part WHERE p_partkey % 9 <> 0)"""


def symbol_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees of every symbol of ``part``: the market's or the configured ones."""
    symbols = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"))
    return meta.fees(symbols, meta.market_details(_lines(spark, sf_dir)), (0.0005, 0.0002))


FEES = f"""WITH {_MARKETS} SELECT concat('P', p_partkey) AS symbol, coalesce(taker_fee, CAST(0.0005 AS DOUBLE)) AS taker_fee, coalesce(maker_fee, CAST(0.0002 AS DOUBLE)) AS maker_fee FROM part LEFT JOIN mk ON market_id = p_partkey"""


def exec_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution records of the metadata."""
    return meta.scan_meta(_lines(spark, sf_dir), "exec", meta.EXEC).drop("ts_ns")


EXEC = """SELECT CASE WHEN o_orderstatus = 'O' THEN 'taker' ELSE 'maker' END AS kind, epoch_us(o_orderdate) * 1000 AS t_decision, epoch_us(o_orderdate) * 1000 + 1000 AS t_sent, epoch_us(o_orderdate) * 1000 + 5000 AS t_ack, p AS t_fill_print,
 concat('S', o_orderkey % 8) AS symbol, 'live' AS mode FROM orders LEFT JOIN (SELECT l_orderkey, min(epoch_us(l_shipdate)) * 1000 AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


def probes_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock offsets told by probes, and whether the session in force is synthetic."""
    raw = _lines(spark, sf_dir)
    probes = meta.scan_meta(raw, "clock_probe", meta.PROBE).withColumn("one", F.lit(1))
    sessions = meta.scan_meta(raw, "session", meta.SESSION).withColumn("one", F.lit(1)).groupBy("one", "ts_ns").agg(F.max("synthetic").alias("synthetic"))
    seen = meta.in_force(probes, sessions, "one", "ts_ns", ["synthetic"], DAY)
    return seen.select("ts_ns", "venue", (F.col("server_ns") - (F.col("send_ns") + F.col("recv_ns")) / 2).alias("offset_ns"), "synthetic")


PROBES = f"""WITH {QUOTES}, s AS (SELECT ts_local_ns, bool_or(event_id % 97 = 0) AS synthetic FROM quotes WHERE event_type = 'signup' GROUP BY 1)
 SELECT q.ts_local_ns AS ts_ns, venue, ts_exch_ns - (q.ts_local_ns - 2000000 + q.ts_local_ns) / 2 AS offset_ns, synthetic FROM quotes q ASOF LEFT JOIN s ON q.ts_local_ns >= s.ts_local_ns WHERE event_type = 'click'"""


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference messages parsed with the instrument mapping as it stood at their time, metadata first at one instant."""
    names = [(f"1000S{i}", f"S{i}", 0.001, T0 - DAY) for i in range(7)] + [("1000S3", "S3", 0.01, T1), ("1000S7", "S7", 0.1, T1)]
    history = spark.createDataFrame(names, "ref_symbol string, symbol string, price_multiplier double, ts_ns long")
    lines = meta.meta_lines(history.groupBy("ts_ns").agg(F.collect_list(F.struct("symbol", "ref_symbol", "price_multiplier", F.lit(True).alias("eligible"))).alias("list")), "instruments", F.col("list"))
    c = lambda x: F.col(x).cast("string")
    bbo = F.concat(F.lit('{"stream":"x","data":{"e":"bookTicker","s":"1000s'), F.substring("symbol", 2, 3), F.lit('","b":"'), c("bid_px"), F.lit('","B":"'), c("bid_sz"), F.lit('","a":"'), c("ask_px"), F.lit('","A":"'), c("ask_sz"), F.lit('"}}'))
    raw = quotes(spark, sf_dir).where("venue = 'ref'").select("venue", "ts_local_ns", F.col("ts_local_ns").alias("ts_wall_ns"), c("event_id").alias("conn_id"), bbo.alias("raw"))
    rows = meta.merged([raw, lines])
    known = meta.scan_list(rows, "instruments", "$.data", meta.INSTRUMENT).select("ts_ns", F.upper("ref_symbol").alias("ref"), F.col("symbol").alias("own"), "price_multiplier")
    seen = feeds.parse_ref(rows.where("venue = 'ref'")).withColumnRenamed("symbol", "ref")
    mapped = meta.in_force(seen.drop("place"), known, "ref", "ts_local_ns", ["own", "price_multiplier"], DAY).where("own is not null")
    k = F.col("price_multiplier")
    return mapped.select(F.col("conn_id").cast("long").alias("event_id"), F.col("own").alias("symbol"), F.round(F.col("px") * k, 8).alias("px"), F.round(F.col("sz") / k, 4).alias("sz"), F.round(F.col("ask_px") * k, 8).alias("ask_px"))


REPLAY = f"""WITH {QUOTES}, k AS (SELECT *, CASE WHEN symbol = 'S3' AND ts_local_ns >= {T1} THEN CAST(0.01 AS DOUBLE) WHEN symbol = 'S7' THEN CASE WHEN ts_local_ns >= {T1} THEN CAST(0.1 AS DOUBLE) END ELSE CAST(0.001 AS DOUBLE) END AS k FROM quotes WHERE venue = 'ref')
 SELECT event_id, symbol, round(bid_px * k, 8) AS px, round(bid_sz / k, 4) AS sz, round(ask_px * k, 8) AS ask_px FROM k WHERE k IS NOT NULL"""


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid grid rows with a return, thinned to at most 1,000 along time and symbol."""
    f = lead_lag_features(spark, sf_dir)
    rows = schema.training_rows(f, "valid", ["lit_ret_1", "ref_ret_1"], 1000, "ts_ns", "symbol", DAY)
    return schema.pruned(rows, ["symbol", "ts_ns"], schema.matching_columns(rows.columns, "xret_", 1))


TRAINING = f"""WITH {MIDS}, f AS ({LEAD_LAG}), v AS (SELECT *, row_number() OVER (ORDER BY ts_ns, symbol) - 1 AS i, count(*) OVER () AS n FROM f WHERE valid AND (lit_ret_1 IS NOT NULL OR ref_ret_1 IS NOT NULL))
 SELECT symbol, ts_ns, xret_1 FROM v WHERE i % greatest(1, CAST(ceil(n / 1000) AS BIGINT)) = 0"""


def common_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that both venues have traded in both halves of the span."""
    q = quotes(spark, sf_dir).where("event_type = 'purchase'")
    part = lambda v, late: q.where((F.col("venue") == v) & ((F.col("ts_local_ns") >= T1) == late)).select("symbol")
    return part("lit", False).intersect(part("ref", False)).intersect(part("lit", True)).intersect(part("ref", True))


COMMON = f"WITH {QUOTES} SELECT symbol FROM quotes WHERE event_type = 'purchase' GROUP BY symbol HAVING count(DISTINCT concat(venue, CAST(ts_local_ns >= {T1} AS VARCHAR))) = 4"

QUERIES = {
    "market_details": (market_details, f"WITH {_MARKETS} SELECT * FROM mk"),
    "symbol_fees": (symbol_fees, FEES),
    "exec_records": (exec_records, EXEC),
    "probes_sessions": (probes_sessions, PROBES),
    "replay": (replay, REPLAY),
    "training_rows": (training_rows, TRAINING),
    "common_symbols": (common_symbols, COMMON),
}
