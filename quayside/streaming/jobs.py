"""Streaming twins of the batch jobs: typed events, health, fills, signals, edge monitor.

Each job takes a streaming DataFrame and gives one; ``run_once`` drives one over the files that
are there (trigger availableNow) into a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from ..operators import risk
from ..operators.feeds import DepthSequence
from ..sources.tables import shared_path
from .ordered import Machine, in_order

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: Files in a micro-batch at most.
FILES = 64


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the schema is that of the batch table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all files there now, as a table."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def typed_events(events: DataFrame) -> DataFrame:
    """Raw rows to quotes with a watermark."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 2 == 0, "lit").otherwise("ref").alias("venue"),
        F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), "event_type", "value", k.alias("delay_ms")).withWatermark("ts", "10 minutes")


def health(events: DataFrame, width: str = "6 hours") -> DataFrame:
    """Messages, delay and last arrival of each stream in each interval."""
    return events.groupBy(F.window("ts", width), "venue", "symbol").agg(
        F.count("*").alias("messages"), F.max("delay_ms").alias("max_delay"), F.max("ts").alias("last")).select(F.col("window.start").alias("start"), "venue", "symbol", "messages", "max_delay", "last")


def silences(events: DataFrame, gap: str = "3 hours") -> DataFrame:
    """Sessions of a stream without a pause of ``gap``: each end is a staleness alarm."""
    return events.groupBy(F.session_window("ts", gap), "venue", "symbol").agg(F.count("*").alias("messages")).select("venue", "symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("alarm"), "messages")


def unique_fills(fills: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Fills counted once by trade id (X06); an id's state goes once the watermark has passed it."""
    return fills.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["trade_id"])


def fill_ledger(fills: DataFrame) -> DataFrame:
    """Orders rolled up from a stream of fills (order_id, trade_id, ts, qty, px, fee) that may come twice.

    Each micro-batch leaves one row of sums for each of its orders in a ledger, and replaces it if it runs again; an order is the
    sum of its rows."""
    spark, path = fills.sparkSession, shared_path(fills.sparkSession)

    def keep(df: DataFrame, batch: int) -> None:
        sums = df.groupBy("order_id").agg(F.count("*").alias("fills"), F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("px")).alias("notional"), F.sum("fee").alias("fees"))
        sums.write.mode("overwrite").parquet(f"{path}/ledger/batch={batch}")

    unique_fills(fills).writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/ledger").groupBy("order_id").agg(*[F.sum(c).alias(c) for c in ("fills", "qty", "notional", "fees")])


def annotated(events: DataFrame, policy: DataFrame) -> DataFrame:
    """Signals with the static policy of their symbol and the choice of execution."""
    c = F.col
    choice = risk.execution_choice(c("value") / 1e5, F.lit(0.001), F.lit(0.6), c("value") / 9e4, F.lit(0.001), F.lit(0.0), F.lit(0.0), c("delay_ms"), c("latency"), F.lit(9), 1.645)
    return events.join(policy, "symbol").select("event_id", "symbol", "value", choice.alias("choice"))


class EdgeMonitor(Machine):
    """See ``edge_monitor``."""

    state = "rets array<double>, multiplier double, reductions int, since int, n long"
    start = ([], 1.0, 0, 0, 0)
    out = "strategy string, n long, multiplier double, reductions int, status string"

    def __init__(self, window: int, least: int, suspend: int) -> None:
        self.window, self.least, self.suspend = window, least, suspend

    def values(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        """Returns and lower bounds of the trades in ``rows``."""
        return np.array([r.ret for r in rows], float), np.array([r.lcb for r in rows], float)

    def steps(self, key: tuple, state: tuple, rows: list) -> tuple[tuple, list[tuple]]:
        rets, multiplier, reductions, since, n = state
        fresh, lcbs = self.values(rows)
        x = np.concatenate((np.asarray(rets, float), fresh))
        ends = np.arange(len(rets) + 1, len(x) + 1)
        starts = np.maximum(0, ends - self.window)
        # moments of every window at once; centred first, so that the differences of sums lose nothing
        centre = x.mean() if len(x) else 0.0
        s1, s2 = (np.concatenate(([0.0], np.cumsum((x - centre) ** p))) for p in (1, 2))
        size = ends - starts
        mean = (s1[ends] - s1[starts]) / size
        se = np.sqrt(np.maximum(0.0, (s2[ends] - s2[starts]) - size * mean**2) / np.maximum(1, size - 1) / size)
        mean = mean + centre
        full = size >= self.least
        lost = full & ((mean + 1.96 * se < 0) | (mean < lcbs - 2 * se))
        proven = full & (mean - 1.96 * se > 0)
        # only trades that can act are looked at: lost ones, and proven ones while the multiplier is reduced
        acts, lost_at, pause, last = np.flatnonzero(lost | proven), np.flatnonzero(lost), self.least // 2, None
        start = max(0, pause - since - 1)
        while reductions < self.suspend:
            at = acts if multiplier < 1 else lost_at
            k = np.searchsorted(at, start)
            if k == len(at):
                break
            last = int(at[k])
            if lost[last]:
                reductions += 1
                multiplier = 0.0 if reductions >= self.suspend else multiplier / 2
            else:
                multiplier = min(1.0, 2 * multiplier)
            start = last + max(1, pause)
        since = since + len(fresh) if last is None else len(fresh) - 1 - last
        n += len(fresh)
        status = "suspended" if reductions >= self.suspend else "reduced" if multiplier < 1 else "ok"
        return (x[-self.window :].tolist(), float(multiplier), int(reductions), int(since), int(n)), [(key[0], n, multiplier, reductions, status)]


def edge_monitor(trades: DataFrame, window: int = 200, least: int = 30, suspend: int = 3, **order: str) -> DataFrame:
    """Multiplier of each strategy after its trades (strategy, ts, id, ret, lcb), a row for each bucket of time: halved while the edge is
    lost, suspended for good at the ``suspend``-th reduction, doubled back when the edge is proven (X07).

    After an action ``least`` // 2 trades pass before the next; a restore takes no reduction back.  State is one window
    of returns for each strategy, and what the watermark holds.
    """
    return in_order(trades, ["strategy"], "ts", ["id"], EdgeMonitor(window, least, suspend), **order)


class EdgeBlocks(EdgeMonitor):
    """The same over blocks of trades (n, rets and lcbs as packed doubles)."""

    chunk = 64

    def values(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(b"".join(bytes(r[c]) for r in rows), "<f8") for c in (rows[0]._fields.index("rets"), rows[0]._fields.index("lcbs")))


def trade_blocks(trades: DataFrame) -> DataFrame:
    """The trades of each strategy and instant as one row, in order of id: numbers go to the monitor packed, not one by one."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        packed = {f"{c}s": [pdf[c].to_numpy("<f8").tobytes()] for c in ("ret", "lcb")}
        return pd.DataFrame({"strategy": pdf["strategy"].iloc[:1].to_numpy(), "ts": pdf["ts"].iloc[:1].to_numpy(), "id": pdf["id"].iloc[:1].to_numpy(), **packed})

    return trades.groupBy("strategy", "ts").applyInPandas(pack, "strategy string, ts long, id long, rets binary, lcbs binary")


def edge_monitor_blocks(blocks: DataFrame, window: int = 200, least: int = 30, suspend: int = 3, **order: str) -> DataFrame:
    """``edge_monitor`` over ``trade_blocks``."""
    return in_order(blocks, ["strategy"], "ts", ["id"], EdgeBlocks(window, least, suspend), **order)


class Continuity(Machine):
    """See ``sequence_monitor``."""

    state, start, out = "last long, synced boolean", (0, False), "event_id long, state string"

    def steps(self, key: tuple, state: tuple, rows: list) -> tuple[tuple, list[tuple]]:
        last, synced = state
        found = []
        for r in rows:
            if r.snapshot:
                kind, synced, last = "snapshot", True, r.nonce or 0
            elif not synced or (r.begin is not None and r.nonce and r.begin != last):
                kind, synced = "gap", False
            else:
                kind, last = "delta", r.nonce or last
            found.append((r.event_id, kind))
        return (last, synced), found

    def late(self, key: tuple, row: object) -> list[tuple]:
        return [(row.event_id, "late")]


def sequence_monitor(messages: DataFrame, **order: str) -> DataFrame:
    """State of each message of a numbered stream (venue, symbol, ts_us, event_id, snapshot, begin, nonce), in order of time (X02);
    the rule is that of ``feeds.continuity``.  A message after the watermark is ``late``."""
    return in_order(messages, ["venue", "symbol"], "ts_us", ["event_id"], Continuity(), **order)


class DepthSync(Machine):
    """See ``depth_monitor``."""

    state, start, out = "last long, synced boolean, bridged boolean", (0, False, False), "event_id long, state string, at_us long"

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("refused", "event_id long, first_id long, last_id long, prev_id long")

    def steps(self, key: tuple, state: tuple, rows: list) -> tuple[tuple, list[tuple]]:
        seen = DepthSequence(self.limit, *state, map(tuple, self.kept.get()))
        found = []
        for r in rows:
            if r.snapshot:
                found.append((r.event_id, "snapshot", r.ts_us))
                found += [(name, kind, r.ts_us) for name, kind in seen.snapshot(r.last_id)]
            else:
                found.append((r.event_id, seen.update((r.event_id, r.first_id, r.last_id, r.prev_id)), r.ts_us))
        self.kept.put(list(seen.waiting)) if seen.waiting else self.kept.clear()
        return (seen.last, seen.synced, seen.bridged), found

    def late(self, key: tuple, row: object) -> list[tuple]:
        return [(row.event_id, "late", row.ts_us)]


def depth_monitor(messages: DataFrame, limit: int = 2000, **order: str) -> DataFrame:
    """What becomes of each depth message (venue, symbol, ts_us, event_id, snapshot, first_id, last_id, prev_id), in order of time.

    The rule is that of ``feeds.depth_sync``.  An update refused while unsynced says ``gap`` at its own time and waits in a list
    of the ``limit`` newest ones; the next snapshot tries the list again, in its order, and what it accepts is a second row,
    with the snapshot's time.  A message's last row is its outcome in ``feeds.release_buffered``.
    """
    return in_order(messages, ["venue", "symbol"], "ts_us", ["event_id"], DepthSync(limit), **order)


def outcomes(log: DataFrame) -> DataFrame:
    """The last row of each message in a log of ``depth_monitor``: released ones count, refusals stay where nothing followed."""
    return log.groupBy("event_id").agg(F.max_by(F.struct("state", "at_us"), F.struct("at_us", F.col("state") != "gap")).alias("o")).select("event_id", "o.*")


class GridSamples(Machine):
    """See ``grid_samples``."""

    state, start = "lit double, ref double, tick long, buy double, sell double, trades long", (None, None, 0, 0.0, 0.0, 0)
    out = "symbol string, tick_us long, lit_mid double, ref_mid double, buy double, sell double, trades long"

    def __init__(self, step_us: int) -> None:
        self.step_us = step_us

    def steps(self, key: tuple, state: tuple, rows: list) -> tuple[tuple, list[tuple]]:
        lit, ref, tick, buy, sell, trades = state
        found = []
        for r in rows:
            tick = tick or (r.ts_us // self.step_us + 1) * self.step_us
            while tick < r.ts_us:
                found.append((key[0], tick, lit, ref, buy, sell, trades))
                tick += self.step_us
            if r.venue == "lit":
                lit, buy, sell, trades = r.mid, buy + r.buy, sell + r.sell, trades + int(r.buy + r.sell > 0)
            else:
                ref = r.mid
        return (lit, ref, tick, buy, sell, trades), found


def grid_samples(events: DataFrame, step_us: int, **order: str) -> DataFrame:
    """State of both venues at each tick that a later event of the symbol has passed (X03): mids, traded volume of the traded
    venue by side, trades.

    ``events``: symbol, venue, event_id, ts_us, mid, buy, sell (volumes, 0 where nothing traded); they count in order of time, and
    late ones don't.  State is a few numbers for each symbol, and what the watermark holds.
    """
    return in_order(events, ["symbol"], "ts_us", ["event_id"], GridSamples(step_us), **order)


class PairTracker(Machine):
    """See ``pair_tracker``."""

    state, start, out = "n long, aa double, bb double, ab double", (0, 1e-8, 1e-8, 0.0), "a string, b string, n long, corr double"

    def __init__(self, halflife: float, least: int) -> None:
        self.alpha, self.least = 1 - 0.5 ** (1 / max(halflife, 1.0)), least

    def steps(self, key: tuple, state: tuple, rows: list) -> tuple[tuple, list[tuple]]:
        n, aa, bb, ab = state
        keep, new = 1 - self.alpha, self.alpha
        for r in rows:
            aa, bb, ab = keep * aa + new * r.ra * r.ra, keep * bb + new * r.rb * r.rb, keep * ab + new * r.ra * r.rb
        n += len(rows)
        return (n, aa, bb, ab), [(*key, n, ab / (aa * bb) ** 0.5 if n >= self.least and aa * bb > 0 else 0.5)]


def pair_tracker(returns: DataFrame, halflife: float, least: int = 100, **order: str) -> DataFrame:
    """Correlation of pairs (a, b) from exponentially weighted products of returns (X08), a row for each bucket of time.

    ``returns``: tick (microseconds), a, b, ra, rb, one row for each pair and tick; 0.5 below ``least`` ticks.
    Variances start at 1e-8, products of different symbols at 0.  State is three numbers for each pair, and what the watermark holds.
    """
    return in_order(returns, ["a", "b"], "tick", ["tick"], PairTracker(halflife, least), **order)
