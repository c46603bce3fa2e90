"""Market-data views of the given tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000_000
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bid and offer of two venues, from ``events``."""
    k = F.get_json_object("props", "$.k").cast("long")
    mid = F.round(100 + F.col("value") / 100, 2)
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return e.select(
        "event_id", "event_type", "value",
        F.when(F.col("event_id") % 2 == 0, "lit").otherwise("ref").alias("venue"),
        F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"),
        ns("ts").alias("ts_local_ns"), (ns("ts") - F.col("k") * 1_000_000).alias("ts_exch_ns"),
        F.round(mid - 0.01 * (F.col("k") % 5 + 1), 2).alias("bid_px"), (F.col("k") % 7 + 1).cast("double").alias("bid_sz"),
        F.round(mid + 0.01 * (F.col("k") % 5 + 1), 2).alias("ask_px"), (F.col("k") % 11 + 1).cast("double").alias("ask_sz"))


QUOTES = """quotes AS (SELECT event_id, event_type, value, CASE WHEN event_id % 2 = 0 THEN 'lit' ELSE 'ref' END AS venue,
 concat('S', CAST(user_id % 8 AS VARCHAR)) AS symbol, epoch_us(ts) * 1000 AS ts_local_ns, epoch_us(ts) * 1000 - k * 1000000 AS ts_exch_ns,
 round(round(100 + value / 100, 2) - CAST(0.01 AS DOUBLE) * (k % 5 + 1), 2) AS bid_px, CAST(k % 7 + 1 AS DOUBLE) AS bid_sz,
 round(round(100 + value / 100, 2) + CAST(0.01 AS DOUBLE) * (k % 5 + 1), 2) AS ask_px, CAST(k % 11 + 1 AS DOUBLE) AS ask_sz
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades, from ``lineitem``: dates are days and rows repeat, so only sums are safe."""
    # a hundredfold is rounded, as SQL does: Spark's round to two places goes by decimal digits, so 1.035 would become 1.04
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_partkey") % 2 == 0, "lit").otherwise("ref").alias("venue"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string")).alias("symbol"), ns("l_shipdate").alias("ts_local_ns"),
        (F.round(F.col("l_extendedprice") / F.col("l_quantity") / 1000 * 100) / 100).alias("price"), F.col("l_quantity").alias("size"),
        F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1).alias("taker_side"),
        ((F.col("l_discount") - 0.05) + (F.col("l_tax") - 0.04) / 10).alias("ret"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("mode"))


TAPE = """tape AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'lit' ELSE 'ref' END AS venue,
 concat('S', CAST(l_suppkey % 8 AS VARCHAR)) AS symbol, epoch_us(l_shipdate) * 1000 AS ts_local_ns,
 round(l_extendedprice / l_quantity / 1000, 2) AS price, l_quantity AS size, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS taker_side,
 (l_discount - CAST(0.05 AS DOUBLE)) + (l_tax - CAST(0.04 AS DOUBLE)) / 10 AS ret, l_returnflag AS model, l_linestatus AS mode FROM lineitem)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of price levels, from ``orders``: the size is absolute, 0 removes; one epoch for each year."""
    o = table(spark, sf_dir, "orders")
    step = 0.05 * (F.floor(F.col("o_orderkey") / 2) % 20 + 1)
    bid = F.col("o_orderkey") % 2 == 0
    return o.select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("S"), (F.col("o_custkey") % 8).cast("string")).alias("symbol"),
        F.when(bid, "bid").otherwise("ask").alias("side"), F.round(F.when(bid, 100 - step).otherwise(100 + step), 2).alias("price"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.round(F.col("o_totalprice") / 1000, 5)).alias("size"),
        (ns("o_orderdate") + F.col("o_orderkey") * 1000).alias("ts_local_ns"), F.year("o_orderdate").cast("long").alias("epoch"))


LEVELS = """levels AS (SELECT o_orderkey AS seq, concat('S', CAST(o_custkey % 8 AS VARCHAR)) AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
 round(CASE WHEN o_orderkey % 2 = 0 THEN 100 - CAST(0.05 AS DOUBLE) * ((o_orderkey // 2) % 20 + 1) ELSE 100 + CAST(0.05 AS DOUBLE) * ((o_orderkey // 2) % 20 + 1) END, 2) AS price,
 CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DOUBLE) ELSE round(o_totalprice / 1000, 5) END AS size,
 epoch_us(o_orderdate) * 1000 + o_orderkey * 1000 AS ts_local_ns, CAST(year(o_orderdate) AS BIGINT) AS epoch FROM orders)"""


def grid(events: DataFrame, step: int) -> DataFrame:
    """(symbol, ts_ns): multiples of ``step`` from after the first event of a symbol to its last."""
    span = events.groupBy("symbol").agg(F.floor(F.min("ts_local_ns") / step).alias("lo"), F.floor(F.max("ts_local_ns") / step).alias("hi")).where("hi > lo")
    return span.select("symbol", F.explode(F.sequence((F.col("lo") + 1) * step, F.col("hi") * step, F.lit(step))).alias("ts_ns"))


GRID = f"""grid AS (SELECT symbol, unnest(range(min(ts_local_ns) // {HOUR} + 1, max(ts_local_ns) // {HOUR} + 1)) * {HOUR} AS ts_ns FROM quotes GROUP BY symbol)"""
