"""Order books as tables of level intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import prefix_scan


def microprice(bid_px: str, bid_sz: str, ask_px: str, ask_sz: str) -> Column:
    """Touch prices weighted by the other side's size; the mid if there is no size."""
    b, bs, a, s = map(F.col, (bid_px, bid_sz, ask_px, ask_sz))
    return F.when(bs + s > 0, (b * s + a * bs) / (bs + s)).otherwise((a + b) / 2)


def order_flow(tops: DataFrame, keys: list[str], order: list[str], bucket: Column, segment: str | None = None) -> DataFrame:
    """``tops`` with ``ofi``: what changes of the touch add and take, cumulated along ``order``; nothing is compared across
    values of ``segment`` (a count of snapshots)."""
    c, touch = F.col, ("bid_px", "bid_sz", "ask_px", "ask_sz")
    t = prefix_scan(tops, [*keys, *([segment] if segment else [])], order, bucket, {"__old": ("last<", F.struct(*touch))})
    old = {x: c("__old")[x] for x in touch}
    step = (
        F.when(c("bid_px") >= old["bid_px"], c("bid_sz")).otherwise(0.0) - F.when(c("bid_px") <= old["bid_px"], old["bid_sz"]).otherwise(0.0)
        - F.when(c("ask_px") <= old["ask_px"], c("ask_sz")).otherwise(0.0) + F.when(c("ask_px") >= old["ask_px"], old["ask_sz"]).otherwise(0.0))
    t = t.withColumn("__step", F.when(c("__old").isNull(), 0.0).otherwise(step))
    return prefix_scan(t, keys, order, bucket, {"ofi": ("sum", c("__step"))}).select(*tops.columns, "ofi")


def message_levels(messages: DataFrame, order: list[str], bucket: Column) -> tuple[DataFrame, DataFrame]:
    """Level changes and validity of books told by messages (symbol, ts_local_ns, seq, kind, bids, asks).

    ``kind`` is snapshot, delta or gap (a gap or disconnect); bids and asks are arrays of (price, size), absolute sizes, 0 removes.
    A snapshot replaces the book: it begins an epoch; a gap ends it.  Returns changes (symbol, epoch, side, price, size,
    seq, ts_local_ns, epoch_end) of valid epochs and validity (symbol, epoch, valid_from, valid_to), whose end is
    null while the book is still valid.
    """
    opens, ends = F.col("kind") == "snapshot", F.col("kind").isin("snapshot", "gap")
    m = prefix_scan(messages, ["symbol"], order, bucket, {"epoch": ("sum", ends.cast("int")), "__last": ("last", F.when(ends, F.col("kind")))})
    spans = m.where(ends).select("symbol", "epoch", "kind", F.col("ts_local_ns").alias("valid_from"))
    until = spans.select("symbol", (F.col("epoch") - 1).alias("epoch"), F.col("valid_from").alias("valid_to"))
    validity = spans.where("kind = 'snapshot'").drop("kind").join(until, ["symbol", "epoch"], "left")
    sides = F.explode(F.array(F.struct(F.lit("bid").alias("side"), F.col("bids").alias("levels")), F.struct(F.lit("ask").alias("side"), F.col("asks").alias("levels"))))
    live = m.where((F.col("__last") == "snapshot") & (opens | (F.col("kind") == "delta"))).select("symbol", "epoch", "seq", "ts_local_ns", sides.alias("s"))
    each = live.select("symbol", "epoch", "seq", "ts_local_ns", "s.side", F.inline("s.levels"))
    changes = each.join(validity.select("symbol", "epoch", F.col("valid_to").alias("epoch_end")), ["symbol", "epoch"])
    return changes, validity


def overlay(book: DataFrame, touch: DataFrame, keys: list[str]) -> DataFrame:
    """``book`` (keys, side, price, size) under a newer touch (keys, bid_px, bid_sz, ask_px, ask_sz): levels better than it are
    stale and go, its own levels get its sizes, deeper ones stay."""
    side = lambda name, px, sz: touch.select(*keys, F.lit(name).alias("side"), F.col(px).alias("__px"), F.col(sz).alias("__sz"))
    new = side("bid", "bid_px", "bid_sz").unionByName(side("ask", "ask_px", "ask_sz"))
    kept = book.join(new, [*keys, "side"], "left")
    stale = F.when(F.col("side") == "bid", F.col("price") >= F.col("__px")).otherwise(F.col("price") <= F.col("__px"))
    kept = kept.where(~F.coalesce(stale, F.lit(False)) | ((F.col("price") == F.col("__px")) & (F.col("__sz") <= 0)))
    return kept.select(*keys, "side", "price", "size").unionByName(new.where("__sz > 0").select(*keys, "side", F.col("__px").alias("price"), F.col("__sz").alias("size")))


def level_intervals(changes: DataFrame) -> DataFrame:
    """symbol, epoch, side, price, size, seq, valid_from, valid_to (null: to the epoch's end) of levels with size.

    A change sets a level's size until the next change of that level in the same epoch, or until ``epoch_end`` if
    the changes have it.
    """
    w = Window.partitionBy("symbol", "epoch", "side", "price").orderBy("ts_local_ns", "seq")
    until = F.coalesce(F.lead("ts_local_ns").over(w), *(["epoch_end"] if "epoch_end" in changes.columns else []))
    out = changes.withColumn("valid_to", until).withColumnRenamed("ts_local_ns", "valid_from")
    return out.where("size > 0").select("symbol", "epoch", "side", "price", "size", "seq", "valid_from", "valid_to")


def book_at(intervals: DataFrame, instants: DataFrame, bucket_ns: int, before: bool = False) -> DataFrame:
    """symbol, epoch, t, side, price, size: the levels in force at each instant (symbol, epoch, t), or just ``before`` it.

    Both sides meet in time buckets.  A level without end gets the last instant of its epoch.
    """
    last = instants.groupBy("symbol", "epoch").agg(F.max("t").alias("__last"))
    spans = intervals.join(last, ["symbol", "epoch"]).withColumn("valid_to", F.coalesce("valid_to", F.col("__last") + 1)).where("valid_to > valid_from")
    spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("valid_from") / bucket_ns), F.floor(F.col("valid_to") / bucket_ns))))
    points = instants.withColumn("__b", F.floor(F.col("t") / bucket_ns))
    held = points.join(spans, ["symbol", "epoch", "__b"]).where("t > valid_from and t <= valid_to" if before else "t >= valid_from and t < valid_to")
    return held.select("symbol", "epoch", "t", "side", "price", "size")


def top(book: DataFrame) -> DataFrame:
    """Best prices and their sizes, null where a side is empty."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    return book.groupBy("symbol", "epoch", "t").agg(
        F.max(F.when(bid, F.col("price"))).alias("bid_px"), F.max_by("size", F.when(bid, F.col("price"))).alias("bid_sz"),
        F.min(F.when(ask, F.col("price"))).alias("ask_px"), F.min_by("size", F.when(ask, F.col("price"))).alias("ask_sz"))


def outward(side: Column, price: Column) -> Column:
    """Sorts levels from the touch outward."""
    return F.when(side == "bid", -price).otherwise(price)


def ranked(book: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol", "epoch", "t", "side").orderBy(outward(F.col("side"), F.col("price")))
    return book.withColumn("rank", F.row_number().over(w))


def walk(book: DataFrame, keys: list[str], by: str, target: float | str) -> DataFrame:
    """What a taker gets for ``target`` (qty or notional, or the name of a column of the book with it): taker, qty, notional, vwap, worst, n_levels, complete.

    Buys consume asks.  ``complete`` tells that the book holds the target, within 1e-6.
    """
    unit = F.col("size") if by == "qty" else F.col("price") * F.col("size")
    w = Window.partitionBy(*keys, "side").orderBy(outward(F.col("side"), F.col("price"))).rowsBetween(Window.unboundedPreceding, 0)
    b = book.withColumn("__unit", unit).withColumn("__before", F.sum("__unit").over(w) - F.col("__unit"))
    goal = F.col(target) if isinstance(target, str) else F.lit(target)
    take = F.greatest(F.lit(0.0), F.least(F.col("__unit"), goal - F.col("__before"))) / (F.lit(1.0) if by == "qty" else F.col("price"))
    b = b.withColumn("__take", take)
    hit = F.when(F.col("__take") > 0, F.col("price"))
    out = b.groupBy(*keys, "side").agg(
        F.sum("__take").alias("qty"), F.sum(F.col("__take") * F.col("price")).alias("notional"), F.count(hit).alias("n_levels"), F.max(hit).alias("__hi"), F.min(hit).alias("__lo"), (F.sum("__unit") >= F.first(goal) - 1e-6).alias("complete"))
    buy = F.col("side") == "ask"
    return out.select(*keys, F.when(buy, "buy").otherwise("sell").alias("taker"), "qty", "notional", (F.col("notional") / F.col("qty")).alias("vwap"), F.when(buy, F.col("__hi")).otherwise(F.col("__lo")).alias("worst"), "n_levels", "complete")


def impact_bps(vwap: str, mid: str, taker: str, complete: str) -> Column:
    sign = F.when(F.col(taker) == "buy", 1).otherwise(-1)
    return F.when(F.col(complete), (F.col(vwap) / F.col(mid) - 1) * 1e4 * sign)
