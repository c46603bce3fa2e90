"""Raw venue messages: scanning, parsing, sequence checks, stream quality."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import prefix_scan
from ..sources.tables import spread, written

DAY_NS = 86_400_000_000_000
#: The hour of raw files that hold all of a day.
WHOLE_DAY = "24"


def split_lines(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ts_local_ns, ts_wall_ns, conn_id, raw of tab-separated lines; lines with fewer parts (torn at a crash) go."""
    parts = F.split(column, "\t", 4)
    out = lines.where(F.size(parts) == 4)
    return out.select(*keep, parts[0].try_cast("long").alias("ts_local_ns"), parts[1].try_cast("long").alias("ts_wall_ns"), parts[2].alias("conn_id"), parts[3].alias("raw"))


def read_raw(spark, root: str, venues: list[str] | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Gzip lines below ``root/venue=../day=../hour=..``: partitions are pruned by hour, rows by [start, end);
    the whole prefix of a truncated file counts."""
    lines = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", False).text(root)
    if venues:
        lines = lines.where(F.col("venue").isin(venues))
    hour = F.concat_ws("/", F.col("day").cast("string"), F.lpad(F.col("hour").cast("string"), 2, "0"))
    stamp = lambda x, form="yyyyMMdd/HH": F.date_format(F.timestamp_micros(F.lit(x // 1000)), form)
    whole, day = F.lpad(F.col("hour").cast("string"), 2, "0") == WHOLE_DAY, F.col("day").cast("string")
    if start_ns is not None:
        lines = lines.where(F.when(whole, day >= stamp(start_ns, "yyyyMMdd")).otherwise(hour >= stamp(start_ns)))
    if end_ns is not None:
        lines = lines.where(F.when(whole, day <= stamp(end_ns, "yyyyMMdd")).otherwise(hour <= stamp(end_ns)))
    out = lines.select("venue", "value").withColumn("__p", F.split("value", "\t", 4)).where(F.size("__p") == 4)
    out = out.select("venue", F.col("__p")[0].try_cast("long").alias("ts_local_ns"), F.col("__p")[1].try_cast("long").alias("ts_wall_ns"), F.col("__p")[2].alias("conn_id"), F.col("__p")[3].alias("raw"))
    if start_ns is not None:
        out = out.where(F.col("ts_local_ns") >= start_ns)
    if end_ns is not None:
        out = out.where(F.col("ts_local_ns") < end_ns)
    return out


def write_raw(rows: DataFrame, root: str, sparse: bool = False) -> None:
    """Rows (venue, ts_local_ns, ts_wall_ns, conn_id, raw) as gzip lines by venue, day and hour.

    ``sparse``: there are few rows an hour but many hours, so files cost more than bytes: a day is one file, of hour ``WHOLE_DAY``."""
    at = F.timestamp_micros(F.expr("ts_local_ns DIV 1000"))
    line = F.concat_ws("\t", F.col("ts_local_ns").cast("string"), F.col("ts_wall_ns").cast("string"), "conn_id", F.translate("raw", "\n", " "))
    out = rows.select("venue", F.date_format(at, "yyyyMMdd").alias("day"), F.date_format(at, "HH").alias("hour"), line.alias("value"))
    if sparse:
        out = spread(out.withColumn("hour", F.lit(WHOLE_DAY)), "venue", "day")
    out.write.mode("append").partitionBy("venue", "day", "hour").option("compression", "gzip").text(root)


def to_ns(x: str) -> Column:
    """Nanoseconds of a time in s, ms, us or ns, by its size; null, zero and negative give 0."""
    v = F.col(x)
    return (
        F.when(v.isNull() | (v <= 0), F.lit(0)).when(v > 10**17, v.cast("long")).when(v > 10**14, v.cast("long") * 1_000)
        .when(v > 10**11, v.cast("long") * 1_000_000).otherwise(F.round(v.cast("double") * 1e9).cast("long")))


LEVEL_PAIRS = "array<array<string>>"



def level_pairs(column: Column) -> Column:
    return F.transform(column, lambda x: F.struct(x[0].try_cast("double").alias("price"), x[1].try_cast("double").alias("size")))


def level_texts(column: Column) -> Column:
    """Levels in either shape, pair or object, from their JSON texts."""
    pair = lambda x: F.from_json(x, F.lit("array<string>"))
    value = lambda x, i, name: F.when(x.startswith("["), pair(x)[i]).otherwise(F.get_json_object(x, f"$.{name}")).try_cast("double")
    return F.transform(column, lambda x: F.struct(value(x, 0, "price").alias("price"), value(x, 1, "size").alias("size")))


def channel_id(column: str) -> Column:
    """The number after the last : or / of a channel."""
    return F.expr(f"try_cast(regexp_extract({column}, '[:/]([0-9]+)$', 1) as int)")


BOOK = "type string, channel string, timestamp long, order_book struct<bids:array<string>,asks:array<string>,nonce:long,begin_nonce:long>"
TRADES = "type string, channel string, trades array<struct<trade_id:string,market_id:int,price:string,size:string,is_maker_ask:boolean,bid_account_id:long,ask_account_id:long>>"
ONE_STAT = "struct<market_id:int,mark_price:string,current_funding_rate:string,funding_rate:string,open_interest:string>"


def parse_lit_books(raw: DataFrame) -> DataFrame:
    """kind (snapshot or delta), market_id, bids, asks, nonce, begin_nonce of book messages."""
    m = raw.withColumn("m", F.from_json("raw", BOOK)).where(F.col("m.type").endswith("order_book"))
    return m.select(
        *[c for c in raw.columns if c != "raw"], F.when(F.col("m.type").startswith("subscribed"), "snapshot").otherwise("delta").alias("kind"), channel_id("m.channel").alias("market_id"),
        level_texts(F.col("m.order_book.bids")).alias("bids"), level_texts(F.col("m.order_book.asks")).alias("asks"), F.col("m.order_book.nonce").alias("nonce"), F.col("m.order_book.begin_nonce").alias("begin_nonce"))


def parse_lit_trades(raw: DataFrame, account: int | None = None) -> DataFrame:
    """One row for each trade of a message: taker side (a maker ask was bought), own side by account."""
    m = raw.withColumn("m", F.from_json("raw", TRADES)).where(F.col("m.type").endswith("trade"))
    t = m.withColumn("t", F.explode("m.trades"))
    own = F.when(F.col("t.bid_account_id") == F.lit(account), 1).when(F.col("t.ask_account_id") == F.lit(account), -1).otherwise(0)
    return t.select(
        *[c for c in raw.columns if c != "raw"], F.coalesce(F.col("t.market_id"), channel_id("m.channel")).alias("market_id"), F.col("t.trade_id").alias("trade_id"),
        F.col("t.price").try_cast("double").alias("price"), F.col("t.size").try_cast("double").alias("size"), F.when(F.col("t.is_maker_ask"), 1).otherwise(-1).alias("taker_side"), own.alias("own_side"))


def parse_lit_stats(raw: DataFrame) -> DataFrame:
    """market_id, mark_price, funding_rate (percent made a fraction), open_interest; one object or a map of them."""
    m = raw.where(F.get_json_object("raw", "$.type").endswith("market_stats")).withColumn("s", F.get_json_object("raw", "$.market_stats"))
    single = F.from_json("s", ONE_STAT)
    many = F.map_values(F.from_json("s", f"map<string,{ONE_STAT}>"))
    each = m.withColumn("x", F.explode(F.when(F.get_json_object("s", "$.market_id").isNotNull(), F.array(single)).otherwise(many)))
    return each.select(
        *[c for c in raw.columns if c != "raw"], F.col("x.market_id").alias("market_id"), F.col("x.mark_price").try_cast("double").alias("mark_price"),
        (F.coalesce("x.current_funding_rate", "x.funding_rate").try_cast("double") / 100).alias("funding_rate"), F.col("x.open_interest").try_cast("double").alias("open_interest"))


def _data(name: str) -> Column:
    """A field of the payload; the venue's names differ in case alone, so no struct can hold them."""
    return F.get_json_object("raw", f"$.data.{name}")


def parse_ref(raw: DataFrame) -> DataFrame:
    """kind, symbol, px, sz, ask_px, ask_sz, taker_side, funding_rate of touch, trade and mark messages; depth messages are in ``parse_ref_depth``."""
    e = _data("e")
    kind = F.when(e == "bookTicker", "bbo").when(e == "aggTrade", "trade").when(e == "markPriceUpdate", "stats")
    bbo, trade = F.col("kind") == "bbo", F.col("kind") == "trade"
    num = lambda c: _data(c).try_cast("double")
    return raw.withColumn("kind", kind).where("kind is not null").select(
        *[c for c in raw.columns if c != "raw"], "kind", F.upper(_data("s")).alias("symbol"), F.when(bbo, num("b")).otherwise(num("p")).alias("px"), F.when(bbo, num("B")).when(trade, num("q")).alias("sz"),
        F.when(bbo, num("a")).alias("ask_px"), F.when(bbo, num("A")).alias("ask_sz"), F.when(trade, F.when(_data("m") == "true", -1).otherwise(1)).alias("taker_side"), F.when(F.col("kind") == "stats", num("r")).alias("funding_rate"))


def parse_ref_depth(raw: DataFrame) -> DataFrame:
    """kind (delta or snapshot), symbol, first, last, previous ids, bids, asks of depth messages and recorded snapshots."""
    stream = F.get_json_object("raw", "$.stream")
    snapshot = stream.startswith("rest:depth:")
    d = raw.where(snapshot | (_data("e") == "depthUpdate"))
    number = lambda c: _data(c).try_cast("long")
    side = lambda short, long: level_pairs(F.from_json(F.coalesce(_data(short), _data(long)), LEVEL_PAIRS))
    return d.select(
        *[c for c in raw.columns if c != "raw"], F.when(snapshot, "snapshot").otherwise("delta").alias("kind"), F.upper(F.when(snapshot, F.split(stream, ":")[2]).otherwise(_data("s"))).alias("symbol"),
        number("U").alias("first_id"), F.coalesce(number("u"), number("lastUpdateId")).alias("last_id"), number("pu").alias("prev_id"), side("b", "bids").alias("bids"), side("a", "asks").alias("asks"))


def canonical_symbols(rows: DataFrame, mapping: DataFrame, price: list[str], size: list[str]) -> DataFrame:
    """Rows with the traded venue's symbol, prices times and sizes over the contract multiplier; unmapped symbols go.

    ``mapping`` has a row (venue_symbol, symbol, multiplier) for each market, so it is small; Spark decides how to join it.
    """
    m = mapping.select(F.upper("venue_symbol").alias("__vs"), F.col("symbol").alias("__s"), F.col("multiplier").alias("__k"))
    out = rows.withColumn("__vs", F.upper("symbol")).join(m, "__vs")
    out = out.withColumn("symbol", F.col("__s")).withColumns({c: F.col(c) * F.col("__k") for c in price}).withColumns({c: F.col(c) / F.col("__k") for c in size})
    return out.select(*rows.columns)


def feed_status(raw: DataFrame) -> DataFrame:
    """Feed markers, told by the first 40 characters: status connected or disconnected for all symbols of a venue."""
    head = F.substring("raw", 1, 40)
    out = raw.where(head.contains('"_feed/'))
    status = F.when(head.contains("_feed/disconnected"), "disconnected").otherwise("connected")
    return out.select(*[c for c in raw.columns if c != "raw"], F.lit("*").alias("symbol"), status.alias("status"))


def continuity(messages: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """``messages`` (snapshot boolean, begin, nonce) with ``state``: snapshot, delta or gap.

    A delta that has a nonce and names a beginning, be it 0, must begin where the message before it ended: at the last
    nonce other than 0 since the snapshot, or at the snapshot's own, 0 if it has none.  From the first that doesn't, and before the first
    snapshot, everything is a gap until the next snapshot.
    """
    snapshot, nonce = F.col("snapshot"), F.coalesce("nonce", F.lit(0))
    # a scan reads its input twice, so it is written before the next one
    m = written(prefix_scan(messages, keys, order, bucket, {"__before": ("last<", F.when(snapshot, nonce).when(nonce != 0, nonce))}))
    bad = ~snapshot & (nonce != 0) & (F.col("begin") != F.col("__before"))
    m = prefix_scan(m, keys, order, bucket, {"__mark": ("last", F.when(snapshot, 0).when(bad, 1))})
    state = F.when(snapshot, "snapshot").when(F.col("__mark") == 0, "delta").otherwise("gap")
    return m.withColumn("state", state).select(*messages.columns, "state")


def depth_sync(messages: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """``messages`` (snapshot boolean, first_id, last_id, prev_id) with ``state``: snapshot, old, delta or gap.

    After a snapshot updates that end before it are old; the first kept one must bridge it.  From then on updates that
    bring nothing new are old, and each other one must name the last as its predecessor; from the first
    that doesn't everything is a gap until the next snapshot.
    """
    # a scan reads its input twice, so it is written before the next one
    m = written(prefix_scan(messages, keys, order, bucket, {"__epoch": ("sum", F.col("snapshot").cast("int")), "__base": ("last", F.when(F.col("snapshot"), F.col("last_id")))}))
    inside, update, last, base = [*keys, "__epoch"], ~F.col("snapshot"), F.col("last_id"), F.col("__base")
    # up to the first break the last id kept is the largest so far: what is dropped is never larger
    m = prefix_scan(m, inside, order, bucket, {"__seen": ("max<", F.when(update, last)), "__bridged": ("max<", F.when(update & (last >= base), 1))})
    bridged, before = F.coalesce(F.col("__bridged") == 1, F.lit(False)), F.greatest("__seen", "__base")
    old = update & F.coalesce(F.when(bridged, last <= before).otherwise(last < base), F.lit(False))
    good = F.coalesce(F.when(bridged, F.col("prev_id") == before).otherwise(F.col("first_id") <= base + 1), F.lit(False))
    m = m.withColumn("__old", old).withColumn("__bad", (update & ~old & ~good).cast("int"))
    m = prefix_scan(written(m), inside, order, bucket, {"__broken": ("max", F.col("__bad"))})
    state = F.when(F.col("snapshot"), "snapshot").when((F.col("__epoch") == 0) | (F.col("__broken") == 1), "gap").when(F.col("__old"), "old").otherwise("delta")
    return m.withColumn("state", state).select(*messages.columns, "state")


class DepthSequence:
    """Synchronisation of one stream of depth messages with a list of refused updates; updates are (name, first_id, last_id, prev_id).

    ``lost`` gathers the names that the list had no room for.
    """

    def __init__(self, limit: int, last: int = 0, synced: bool = False, bridged: bool = False, waiting: Iterable[tuple] = ()) -> None:
        self.limit, self.last, self.synced, self.bridged, self.waiting, self.lost = limit, last, synced, bridged, deque(waiting), []

    def _judge(self, update: tuple) -> str:
        _, first, last, prev = update
        if self.synced and (last < self.last or (self.bridged and last == self.last)):
            return "old"
        if self.synced and (prev == self.last if self.bridged else first <= self.last + 1):
            self.last, self.bridged = last, True
            return "delta"
        self.synced = False
        self.waiting.append(update)
        if len(self.waiting) > self.limit:
            self.lost.append(self.waiting.popleft()[0])
        return "gap"

    def snapshot(self, last: int) -> list[tuple]:
        """(name, old or delta) of the waiting updates that count now."""
        self.last, self.synced, self.bridged = last, True, False
        tries, self.waiting = self.waiting, deque()
        judged = [(u[0], self._judge(u)) for u in tries]
        return [j for j in judged if j[1] != "gap"]

    def update(self, update: tuple) -> str:
        return self._judge(update)


def release_buffered(messages: DataFrame, keys: list[str], order: list[str], bucket: Column, limit: int = 2000) -> DataFrame:
    """``keys``, ``order``, ``state`` and ``at`` of ``messages`` as in ``depth_sync``: updates refused while unsynced are kept, at most the
    ``limit`` newest, and tried again at the next snapshot, arriving with it, until none is left to try.

    ``at`` is the first of ``order`` at which a message counts; a refused one's is null.

    What waits at a snapshot newer than every update before it is old, so nothing before such a snapshot matters after it: a key falls
    into runs that begin there (two scans), and each run is one pass in order, whose memory is the list.  The number
    of snapshots doesn't matter; a run is long only where no snapshot ever overtakes the updates.
    """
    # a scan reads its input twice, so it is written before the next one
    update = ~F.col("snapshot")
    m = messages.select(*keys, *order, "snapshot", *(F.col(c).cast("long").alias(c) for c in ("first_id", "last_id", "prev_id")))
    m = written(prefix_scan(m, keys, order, bucket, {"__top": ("max<", F.when(update, F.col("last_id")))}))
    fresh = F.col("snapshot") & (F.coalesce("__top", F.lit(-1)) < F.col("last_id"))
    m = prefix_scan(m, keys, order, bucket, {"__run": ("sum", fresh.cast("int"))})
    run = [*keys, "__run"]
    place = [*keys, *order]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_run, seen, out = None, None, []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            if final and seen:
                out.extend((*u[0], "gap", None) for u in seen.waiting)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*place, "state", "at"])
                out.clear()

        for b in batches:
            types = [*(b.schema.field(c).type for c in place), pa.string(), b.schema.field(order[0]).type]
            names = zip(*(b.column(c).to_pylist() for c in place), strict=True)
            rows = zip(*(b.column(c).to_pylist() for c in run), strict=True)
            for name, here, snapshot, *ids in zip(names, rows, *(b.column(c).to_pylist() for c in ("snapshot", "first_id", "last_id", "prev_id")), strict=True):
                if here != last_run:
                    yield from flush(True)
                    last_run, seen = here, DepthSequence(limit)
                at = name[len(keys)]
                if snapshot:
                    out.append((*name, "snapshot", at))
                    out.extend((*n, kind, at) for n, kind in seen.snapshot(ids[1]))
                elif (kind := seen.update((name, *ids))) != "gap":
                    out.append((*name, kind, at))
                out.extend((*n, "gap", None) for n in seen.lost)
                seen.lost.clear()
            yield from flush(False)
        yield from flush(True)

    types = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in place) + f", state string, at {types[order[0]]}"
    return m.repartition(*run).sortWithinPartitions(*run, *order).mapInArrow(walk, schema)


def fan_out(statuses: DataFrame, streams: DataFrame) -> DataFrame:
    """``statuses`` with one row for each stream (venue, symbol) of the venue where the symbol is ``*``; a status of one symbol stays."""
    one = statuses.where("symbol <> '*'")
    each = statuses.where("symbol = '*'").drop("symbol").join(streams.select("venue", "symbol").distinct(), "venue")
    return one.unionByName(each)


def stream_quality(events: DataFrame) -> DataFrame:
    """By stream (venue, symbol): messages, trades, updates, gaps, disconnects, span, longest silence, regressions.

    ``events``: kind in trade, update, gap, disconnect; ts_local_ns, ts_exch_ns, event_id.  Gaps and disconnects are statuses of
    the feed: they aren't messages, and one for ``*`` counts once for each stream of its venue.
    """
    status = F.col("kind").isin("gap", "disconnect")
    messages = events.where(~status)
    seen = prefix_scan(messages, ["venue", "symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY_NS), {
        "__max": ("max", F.when(F.col("kind") == "update", F.col("ts_exch_ns"))), "__before": ("last<", F.col("ts_local_ns"))})
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    streams = seen.groupBy("venue", "symbol").agg(
        F.count("*").alias("messages"), n("trade").alias("trades"), n("update").alias("updates"),
        F.round((F.max("ts_local_ns") - F.min("ts_local_ns")) / 3.6e12, 6).alias("span_hours"), F.round(F.max((F.col("ts_local_ns") - F.col("__before")) / 1e6), 3).alias("max_silence_ms"),
        F.count(F.when((F.col("kind") == "update") & (F.col("ts_exch_ns") < F.col("__max")), 1)).alias("regressions"))
    counts = events.where(status).groupBy("venue", "symbol").agg(n("gap").alias("gaps"), n("disconnect").alias("disconnects"))
    counts = fan_out(counts, streams).groupBy("venue", "symbol").agg(F.sum("gaps").alias("gaps"), F.sum("disconnects").alias("disconnects"))
    return streams.join(counts, ["venue", "symbol"], "left").fillna(0, ["gaps", "disconnects"])


def newest(events: DataFrame, keys: list[str], order: list[str], bucket: Column, last: int) -> DataFrame:
    """The ``last`` rows of each key along ``order``."""
    back = events.withColumns({f"__b{i}": -F.col(c) for i, c in enumerate(order)})
    return prefix_scan(back, keys, [f"__b{i}" for i in range(len(order))], -bucket, {"__n": ("count", F.lit(1))}).where(F.col("__n") <= last).select(*events.columns)


def delay_quantiles(events: DataFrame, last: int, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles of the arrival delay (ms) of each stream's ``last`` messages."""
    e = newest(events, ["venue", "symbol"], ["ts_local_ns", "event_id"], F.floor(F.col("ts_local_ns") / DAY_NS), last)
    d = (F.col("ts_local_ns") - F.col("ts_exch_ns")) / 1e6
    return e.groupBy("venue", "symbol").agg(*[F.round(F.percentile(d, F.lit(q)), 4).alias(f"p{round(q * 100)}") for q in qs])


def merge_quality(daily: DataFrame) -> DataFrame:
    """Reports of parts as one: counts add, maxima stay, quantiles weigh by messages."""
    return daily.groupBy("venue", "symbol").agg(
        F.sum("messages").alias("messages"), F.max("max_delay").alias("max_delay"), F.round(F.sum(F.col("p50") * F.col("messages")) / F.sum("messages"), 6).alias("p50"))
