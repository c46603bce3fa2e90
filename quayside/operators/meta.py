"""Metadata beside raw messages: written as lines of venue ``meta``, read by kind, and joined as it stood at the time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import asof_join

META = "meta"
MARKET = (
    "struct<market_id:int,symbol:string,status:string,market_type:string,taker_fee:string,maker_fee:string,min_base_amount:string,min_quote_amount:string,size_decimals:int,"
    "supported_size_decimals:int,price_decimals:int,supported_price_decimals:int,default_initial_margin_fraction:string,min_initial_margin_fraction:string,maintenance_margin_fraction:string,"
    "last_trade_price:string,daily_quote_token_volume:string>")
INSTRUMENT = "struct<symbol:string,ref_symbol:string,price_multiplier:double,eligible:boolean>"
EXEC = "struct<kind:string,t_decision:long,t_sent:long,t_ack:long,t_fill_print:long,symbol:string,mode:string>"
PROBE = "struct<venue:string,send_ns:long,recv_ns:long,server_ns:long>"
SESSION = "struct<synthetic:boolean,version:string>"
#: Margins are told in ten thousandths.
MARGIN_SCALE = 10_000.0


def meta_lines(rows: DataFrame, kind: str, payload: Column) -> DataFrame:
    """Raw rows (venue, ts_local_ns, ts_wall_ns, conn_id, raw) that hold ``payload`` as metadata of ``kind``; ``rows`` has ts_ns."""
    line = F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("data")))
    return rows.select(F.lit(META).alias("venue"), F.col("ts_ns").alias("ts_local_ns"), F.col("ts_ns").alias("ts_wall_ns"), F.lit(META).alias("conn_id"), line.alias("raw"))


def scan_meta(raw: DataFrame, kind: str, schema: str) -> DataFrame:
    """ts_ns and the fields of one kind of metadata among raw rows."""
    m = raw.where((F.col("venue") == META) & (F.get_json_object("raw", "$.type") == kind))
    return m.select(F.col("ts_local_ns").alias("ts_ns"), F.from_json(F.get_json_object("raw", "$.data"), schema).alias("d")).select("ts_ns", "d.*")


def scan_list(raw: DataFrame, kind: str, path: str, schema: str) -> DataFrame:
    """The same for metadata that is a list: one row for each element."""
    m = raw.where((F.col("venue") == META) & (F.get_json_object("raw", "$.type") == kind))
    return m.select(F.col("ts_local_ns").alias("ts_ns"), F.inline(F.from_json(F.get_json_object("raw", path), f"array<{schema}>")))


def market_details(raw: DataFrame, fee_unit: str = "percent") -> DataFrame:
    """Perpetual markets as told: fees as fractions, margins from ten thousandths, defaults where a field is missing."""
    m = scan_list(raw, "lighter_markets", "$.data.order_book_details", MARKET)
    number = lambda c, d: F.coalesce(F.col(c).try_cast("double"), F.lit(d))
    fee = lambda c: number(c, 0.0) / (100 if fee_unit == "percent" else 1)
    margin = lambda c, d: F.coalesce(F.col(c).try_cast("double") / MARGIN_SCALE, F.lit(d))
    kind = F.lower(F.coalesce("market_type", F.lit("perp")))
    return m.where(kind.isin("perp", "perps", "perpetual")).select(
        "ts_ns", "market_id", "symbol", F.coalesce("status", F.lit("active")).alias("status"), fee("taker_fee").alias("taker_fee"), fee("maker_fee").alias("maker_fee"),
        number("min_base_amount", 0.0).alias("min_base"), number("min_quote_amount", 0.0).alias("min_quote"), F.coalesce("size_decimals", "supported_size_decimals", F.lit(4)).alias("size_decimals"),
        F.coalesce("price_decimals", "supported_price_decimals", F.lit(2)).alias("price_decimals"), margin("default_initial_margin_fraction", 0.1).alias("default_imf"),
        margin("min_initial_margin_fraction", 0.1).alias("min_imf"), margin("maintenance_margin_fraction", 0.05).alias("mmf"), F.col("last_trade_price").try_cast("double").alias("last_price"),
        number("daily_quote_token_volume", 0.0).alias("volume"))


def fees(symbols: DataFrame, markets: DataFrame, default: tuple[float, float], override: bool = False) -> DataFrame:
    """symbol, taker_fee, maker_fee: the configured ones if they override, else those of the symbol's latest market row, else
    the configured ones."""
    taker, maker = F.lit(default[0]), F.lit(default[1])
    if override:
        return symbols.select("symbol", taker.alias("taker_fee"), maker.alias("maker_fee"))
    last = markets.groupBy("symbol").agg(F.max_by(F.struct("taker_fee", "maker_fee"), F.struct("ts_ns", "market_id")).alias("m"))
    j = symbols.join(last, "symbol", "left")
    return j.select("symbol", F.coalesce("m.taker_fee", taker).alias("taker_fee"), F.coalesce("m.maker_fee", maker).alias("maker_fee"))


def in_force(rows: DataFrame, history: DataFrame, key: str, ts: str, cols: list[str], bucket_ns: int) -> DataFrame:
    """``rows`` with ``cols`` of the last metadata (key, ts_ns, cols) of the same ``key`` at or before ``ts``; metadata of the same
    instant counts already, metadata from before the rows' span too."""
    return asof_join(rows, history.withColumnRenamed("ts_ns", "__meta_ns"), [key], ts, "__meta_ns", cols, bucket_ns)


def merged(venues: list[DataFrame]) -> DataFrame:
    """Raw rows of several venues as one table with their ``place``: by time, metadata first at one instant, then by venue and line.

    No global sort: windows and scans order by ``place``."""
    rows = venues[0]
    for more in venues[1:]:
        rows = rows.unionByName(more)
    return rows.withColumn("place", F.struct("ts_local_ns", (F.col("venue") != META).alias("market"), "venue", "conn_id", "raw"))
