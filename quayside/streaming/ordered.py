"""Stateful streams whose rows count in the order of their time, whatever files or micro-batches bring them.

``InOrder`` keeps the rows of a key in buckets of event time.  A timer at the end of a bucket fires once the watermark has
passed it; only then its rows, sorted, go through the machine of the job.  So the same rows give one result whether they come in
one file or in fifty, as long as none comes later than the watermark's delay; a row that does is a result of its own, ``late``.
State of a key is what the watermark's delay holds of its rows, and the machine's own.
"""

from __future__ import annotations

import datetime
from collections import namedtuple
from collections.abc import Iterator
from operator import attrgetter
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.tables import shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Microseconds of the end marker: the year 2100.
FAR = 4_102_444_800_000_000
CHUNK = 10_000


class Machine:
    """A job's state and its steps.  ``state`` is the schema of the state, ``start`` its first value, ``out`` the schema of results."""

    state = out = ""
    start: tuple = ()
    #: Rows of a key held in memory before they go to the state.
    chunk = CHUNK

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Further state of the job."""

    def steps(self, key: tuple, state: tuple, rows: list) -> tuple[tuple, list[tuple]]:
        """The state after ``rows``, which come in order, and the results they give."""
        raise NotImplementedError

    def late(self, key: tuple, row: Any) -> list[tuple]:
        """What a row gives whose time is closed."""
        return []


class InOrder(StatefulProcessor):
    def __init__(self, machine: Machine, columns: list[tuple[str, str]], time: str, order: list[str], width_ms: int) -> None:
        self.machine, self.columns, self.time, self.order, self.width = machine, columns, time, order, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = namedtuple("Row", [c for c, _ in self.columns])
        self.result = Row(*(c.split()[0] for c in self.machine.out.split(",")))
        self.place = attrgetter(*self.order)
        self.chunks = handle.getMapState("chunks", "bucket long", "n long")
        self.waiting = handle.getMapState("waiting", "bucket long, chunk long", f"rows array<struct<{', '.join(f'{c}: {t}' for c, t in self.columns)}>>")
        self.value = handle.getValueState("state", self.machine.state)
        self.machine.open(handle)

    def _keep(self, fresh: dict[int, list[tuple]]) -> None:
        for bucket, rows in fresh.items():
            n = self.chunks.getValue((bucket,))[0] if self.chunks.containsKey((bucket,)) else 0
            if not n:
                self.handle.registerTimer((bucket + 1) * self.width)
            self.waiting.updateValue((bucket, n), (rows,))
            self.chunks.updateValue((bucket,), (n + 1,))
        fresh.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs() // self.width
        fresh: dict[int, list[tuple]] = {}
        held = 0
        for row in rows:
            bucket = row[self.time] // 1000 // self.width
            if bucket < closed:
                yield from (self.result(*r) for r in self.machine.late(key, row))
                continue
            fresh.setdefault(bucket, []).append(tuple(row[c] for c, _ in self.columns))
            held += 1
            if held == self.machine.chunk:
                self._keep(fresh)
                held = 0
        self._keep(fresh)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        # a key's timers fire in their order
        bucket = expiredTimerInfo.getExpiryTimeInMs() // self.width - 1
        rows = []
        for chunk in range(self.chunks.getValue((bucket,))[0]):
            rows += [self.row(*r) for r in self.waiting.getValue((bucket, chunk))[0]]
            self.waiting.removeKey((bucket, chunk))
        self.chunks.removeKey((bucket,))
        state = tuple(self.value.get()) if self.value.exists() else self.machine.start
        state, found = self.machine.steps(key, state, sorted(rows, key=self.place))
        self.value.update(state)
        yield from (self.result(*r) for r in found)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: list[str], time: str, order: list[str], machine: Machine, delay: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """``stream`` through ``machine`` by ``keys``, in order of ``time`` (microseconds) and ``order``.

    Rows may come up to ``delay`` after later ones; results come when the watermark has passed a bucket of ``width``.  A
    row whose keys are null only moves the watermark on, as an end marker does.
    """
    columns = [(f.name, f.dataType.simpleString()) for f in stream.schema.fields if f.name not in keys]
    # the watermark's column is dropped: Spark would drop late rows by it, and here they are results
    # the condition names it, or it would be pushed below the watermark and take the end marker away
    named = F.when(F.col("__at").isNotNull(), F.expr(" and ".join(f"{k} is not null" for k in keys))).otherwise(False)
    marked = stream.withColumn("__at", F.timestamp_micros(time)).withWatermark("__at", delay).where(named).drop("__at")
    width_ms = int(parse_interval(width).total_seconds() * 1000)
    processor = InOrder(machine, columns, time, [time, *[o for o in order if o != time]], width_ms)
    return marked.groupBy(*keys).transformWithState(processor, machine.out, "append", "eventTime")


def parse_interval(text: str) -> datetime.timedelta:
    number, unit = text.split()
    return datetime.timedelta(**{unit.rstrip("s") + "s": float(number)})


def landed(df: DataFrame, time: str) -> DataFrame:
    """``df`` written to the shared folder and read back as a stream, all of it in one micro-batch; a last row without
    keys, far ahead in ``time``, closes all buckets."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "landed")
    df.write.parquet(path)
    close(df, path, time)
    return spark.readStream.schema(df.schema).parquet(path)


def close(df: DataFrame, path: str, time: str) -> None:
    """Appends the end marker to a folder of ``df``'s rows."""
    far = df.sparkSession.range(1).select(*(F.lit(FAR if f.name == time else None).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    far.coalesce(1).write.mode("append").parquet(path)


def run_ordered(stream: DataFrame) -> DataFrame:
    """All results of a stream of ``in_order`` for the files that are there, as a table."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
