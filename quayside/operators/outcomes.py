"""Outcomes of decisions, built in chunks of time that read more than they write.

A chunk of decisions in [start, end) reads the quotes and trades from ``start`` less how old a quote may be to ``end`` plus the longest
wait, horizon and latency, and some seconds.  So a row doesn't depend on how the time is cut, and chunks can be built
apart, in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import asof_join, interval_join, uniform
from ..sources.tables import written

SIDES = {"long": 1, "short": -1}
SPARE = 5_000_000_000


@dataclass(frozen=True)
class Passive:
    """How a resting order is made and left; times in ns."""

    step: int
    fresh: int
    wait: int
    horizons: Sequence[tuple[str, int]]
    latency: int
    maker: float
    taker: float
    seed: str

    def reads(self, start: int, end: int) -> tuple[int, int]:
        """The time that decisions in [start, end) depend on."""
        return start - self.fresh, end + self.wait + max(h for _, h in self.horizons) + self.latency + SPARE


def passive_labels(quotes: DataFrame, trades: DataFrame, start: int, end: int, data_end: int, rule: Passive, bucket: int) -> DataFrame:
    """symbol, ts_ns, ppx, pfill, pwait_ms by side and pret by side and horizon, of decisions at multiples of ``rule.step`` in [start, end) that have a fresh quote.

    ``quotes``: symbol, ts, id, bid, bid_sz, ask, ask_sz; ``trades``: symbol, ts, id, px, sz, taker.  An order rests at its own
    touch behind the size shown; an opposite taker's trade fills it that goes through its price, or that completes the queue and one
    more at it.  Fills are left at the touch a horizon and a drawn latency later, for the maker's fee in and the taker's out.  What the data's
    end cuts off is null.
    """
    lo, hi = rule.reads(start, end)
    near = lambda df: df.where((F.col("ts") >= lo) & (F.col("ts") < hi))
    q, t = written(near(quotes)), near(trades)
    first = -(-start // rule.step) * rule.step
    ticks = F.explode(F.sequence(F.lit(first), F.lit(max(first, end - 1)), F.lit(rule.step)))
    d = q.select("symbol").distinct().withColumn("ts_ns", ticks).where(F.col("ts_ns") < end)
    e = asof_join(d, q.withColumn("at", F.col("ts")), ["symbol"], "ts_ns", "ts", ["bid", "bid_sz", "ask", "ask_sz", "at"], bucket, "id").where(F.col("ts_ns") - F.col("at") <= rule.fresh)
    resting = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("bid").alias("rest"), F.col("bid_sz").alias("queue")), F.struct(F.lit(-1).alias("side"), F.col("ask").alias("rest"), F.col("ask_sz").alias("queue"))))
    orders = written(e.select("symbol", "ts_ns", resting.alias("o")).select("symbol", "ts_ns", "o.*").withColumn("until", F.col("ts_ns") + rule.wait))
    met = interval_join(t, orders, ["symbol"], "ts", "ts_ns", "until", rule.wait).where(F.col("taker") == -F.col("side"))
    # a resting order sees the trades of its own window only
    w = Window.partitionBy("symbol", "ts_ns", "side").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    through = (F.col("px") - F.col("rest")) * F.col("side")
    met = met.withColumn("__at", F.sum(F.when(through == 0, F.col("sz")).otherwise(0.0)).over(w))
    hit = (through < 0) | ((through == 0) & (F.col("__at") >= F.col("queue") + 1))
    fills = met.groupBy("symbol", "ts_ns", "side").agg(F.min(F.when(hit, F.col("ts"))).alias("t_fill"))
    o = written(orders.join(fills, ["symbol", "ts_ns", "side"], "left"))
    due = F.explode(F.array(*(F.struct(F.lit(n).alias("h"), (F.col("t_fill") + h + F.floor(uniform(rule.seed, F.col("symbol"), F.col("ts_ns"), F.col("side"), n) * rule.latency).cast("long")).alias("t_out")) for n, h in rule.horizons)))
    outs = o.where("t_fill is not null").select("symbol", "ts_ns", "side", "rest", due.alias("x")).select("symbol", "ts_ns", "side", "rest", "x.*").where(F.col("t_out") <= data_end)
    outs = asof_join(outs, q, ["symbol"], "t_out", "ts", ["bid", "ask"], bucket, "id")
    px = F.when(F.col("side") == 1, F.col("bid")).otherwise(F.col("ask"))
    net = (px - F.col("rest")) / F.col("rest") * F.col("side") - rule.maker - rule.taker * px / F.col("rest")
    keys = ["symbol", "ts_ns"]
    left = outs.groupBy(*keys).agg(*(F.max(F.when((F.col("side") == s) & (F.col("h") == n), F.round(net, 8))).alias(f"pret_{name}_{n}") for name, s in SIDES.items() for n, _ in rule.horizons))
    state = F.when(F.col("t_fill").isNotNull(), 1).when(F.col("until") <= data_end, 0)
    of = lambda s, x: F.max(F.when(F.col("side") == s, x))
    wide = o.groupBy(*keys).agg(*(c for name, s in SIDES.items() for c in (of(s, F.col("rest")).alias(f"ppx_{name}"), of(s, state).alias(f"pfill_{name}"), of(s, F.round((F.col("t_fill") - F.col("ts_ns")) / 1e6, 3)).alias(f"pwait_ms_{name}"))))
    return wide.join(left, keys, "left")
