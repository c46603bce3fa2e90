"""Operator 11: shortest-pack-first packing over the histogram of lengths.

Documents longer than a sequence are cut into full pieces and a rest.  The rests' lengths are counted: at most
``capacity`` - 1 counts, whatever the corpus, and only they reach the driver.  There every length, longest
first, goes to the pack with the most room; packs of one pattern are one row with a count, and so are the
pieces.  The patterns, some thousands at most with some dozens of lengths each, go back to the tasks, where a piece's rank among the
pieces of its length says which slot of which pattern, so which sequence and offset, is its own.

What room is left is then closed by cuts.  Of ``total`` ids, ``total // capacity`` sequences can be full: the
fullest ones stay, and the ids of all others, laid end to end, run through the stayers' room, piece by
piece.  Before that, a sequence with little room lends its last piece, so that no fragment is as small as that
room.  The last ids, fewer than a sequence, go to sequences of powers of two.  Nothing is padded.  All this
is arithmetic on the patterns' counts: a task places its pieces by itself.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, written
from .tokenize import token_ids

CAPACITY = 2048
END = 1
#: A sequence with less room than this lends its last piece, so that the cut is not that small.
LEAST = 64

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (count, {length: copies}) that hold ``histogram`` {length: pieces}, fullest first.

    A step moves as many packs of one pattern as it can, and as many copies at once as leave the pack the shortest.
    """
    rooms: list[tuple[int, int]] = []  # most room first; the number says which pack
    packs: dict[int, tuple[int, dict[int, int]]] = {}

    def push(count: int, room: int, items: dict[int, int]) -> None:
        if count:
            packs[len(packs)] = (count, items)
            heapq.heappush(rooms, (-room, len(packs) - 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or -rooms[0][0] < length:
                copies = capacity // length
                push(left // copies, capacity - copies * length, {length: copies})
                if left % copies:
                    push(1, capacity - left % copies * length, {length: left % copies})
                break
            room, number = heapq.heappop(rooms)
            count, items = packs[number]
            room, next_room = -room, -rooms[0][0] if rooms else 0
            copies = max(1, min((room - next_room) // length, left // count))
            moved = min(count, left // copies)
            push(count - moved, room, items)
            push(moved, room - copies * length, items | {length: items.get(length, 0) + copies})
            left -= moved * copies
    kept = [packs[number] for _, number in rooms]
    return sorted(kept, key=lambda p: (-sum(k * v for k, v in p[1].items()), sorted(p[1].items())))


class Plan:
    """Places of pieces by length and rank: tables of patterns and of slots, all of them small."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        patterns = shortest_pack_first(histogram, capacity)
        total = sum(k * v for k, v in histogram.items())
        self.full = total // capacity  # sequences that end up full: the first ones
        lengths = np.array(sorted(histogram), np.int64)
        counts = np.array([histogram[k] for k in lengths.tolist()], np.int64)
        self.first_of = np.zeros(capacity + 1, np.int64)  # number of the first piece of a length
        self.first_of[lengths] = np.cumsum(counts) - counts

        count = np.array([c for c, _ in patterns], np.int64)
        self.base = np.cumsum(count) - count
        self.fill = np.array([sum(k * v for k, v in p.items()) for _, p in patterns], np.int64)
        stay = np.clip(self.full - self.base, 0, count)
        room = np.where(stay > 0, capacity - self.fill, 0)
        last = np.array([min(p) for _, p in patterns], np.int64)
        lends = (room > 0) & (room < LEAST) & (np.array([len(p) + max(p.values()) for _, p in patterns]) > 2)
        self.lent = np.where(lends, last, 0)
        self.gap = room + self.lent
        # places in the stream of loose ids: first the lent pieces, then the sequences that don't stay
        ends = np.cumsum(stay * self.lent)
        self.lent_at = ends - stay * self.lent
        loose = (count - stay) * self.fill
        self.loose_at = (ends[-1] if len(ends) else 0) + np.cumsum(loose) - loose
        self.loose_from = np.maximum(self.base, self.full)
        # cells that the stream fills: gaps of the stayers, then powers of two
        gaps = stay * self.gap
        self.gap_at, self.gaps = np.cumsum(gaps) - gaps, int(gaps.sum())
        self.tails = [1 << k for k in reversed(range(capacity.bit_length())) if total % capacity >> k & 1]

        slots = sorted((length, g, c, copies) for g, (c, p) in enumerate(patterns) for length, copies in p.items())
        self.slot_group = np.array([s[1] for s in slots], np.int64)
        self.slot_copies = np.array([s[3] for s in slots], np.int64)
        self.slot_first = np.cumsum(np.array([0, *(c * m for _, _, c, m in slots)], np.int64))[:-1]
        places = [dict(zip(sorted(p, reverse=True), np.cumsum([0, *(k * p[k] for k in sorted(p, reverse=True))]).tolist(), strict=False)) for _, p in patterns]
        self.slot_offset = np.array([places[g][length] for length, g, _, _ in slots], np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset, and position in the stream of loose ids (-1: the piece stays)."""
        number = self.first_of[length] + rank
        slot = np.searchsorted(self.slot_first, number, "right") - 1
        g, copies = self.slot_group[slot], self.slot_copies[slot]
        pack, copy = np.divmod(number - self.slot_first[slot], copies)
        sequence, offset = self.base[g] + pack, self.slot_offset[slot] + copy * length
        stays = sequence < self.full
        lent = stays & (self.lent[g] == length) & (copy == copies - 1)
        loose = np.where(stays, -1, self.loose_at[g] + (sequence - self.loose_from[g]) * self.fill[g] + offset)
        return sequence, offset, np.where(lent, self.lent_at[g] + pack * length, loose)

    def cuts(self, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, length) of the parts of a loose piece at a position of the stream."""
        while length:
            if at < self.gaps:
                g = int(np.searchsorted(self.gap_at, at, "right")) - 1
                pack, inside = divmod(at - int(self.gap_at[g]), int(self.gap[g]))
                size = int(self.gap[g]) - inside
                found = int(self.base[g]) + pack, int(self.fill[g] - self.lent[g]) + inside
            else:
                inside = at - self.gaps
                for k, size in enumerate(self.tails):
                    if inside < size:
                        break
                    inside -= size
                size -= inside
                found = self.full + k, inside
            size = min(size, length)
            yield *found, size
            at, length = at + size, length - size


def pieces_of(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """Every document's ids in pieces; rests keep their ids (2 or 4 bytes each), and their number among the task's rests of the length."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = token_ids(tokenizer), TaskContext.get().partitionId(), Counter()
        for b in batches:
            for lo in range(0, len(b), 500):
                piece = b.slice(lo, 500)
                row, out = [], []
                for i, ids in enumerate(encoder.encode(piece.column("text").to_pylist())):
                    ids += last
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        cut = ids[4 * at : 4 * (at + capacity)]
                        length, kept, nth = len(cut) // 4, None, 0
                        if length < capacity:
                            tokens = np.frombuffer(cut, "<u4")
                            kept = tokens.astype("<u2").tobytes() if tokens.max() < 1 << 16 else cut
                            nth = seen[length]
                            seen[length] += 1
                        row.append(i)
                        out.append((at, length, zlib.crc32(cut), n, part, nth, kept))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 6 + (pa.binary(),), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(row)), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "ids"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long, ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def pack_by_histogram(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every row of ``docs`` (doc_id, text).

    ``capacity`` is a power of two.  Null text counts as empty: its piece is the end id alone.  Repeated rows are packed each, a null
    doc_id stays null, ties of length fall by task and order of reading, other columns are ignored, a very long
    text gives full pieces and one rest, and an empty table gives no rows.
    """
    pieces = written(pieces_of(docs, tokenizer, end, capacity), "histogram-pieces")
    rests = pieces.where(F.col("length") < capacity)
    counts = rests.groupBy("part", "length").agg(F.count("*").alias("n"))
    # one row for each length: below ``capacity`` of them
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    # one row for each task that wrote pieces, in each length
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            sequence, offset, loose = plan.place(length, b.column("rank").to_numpy(zero_copy_only=False))
            stay = pa.array(np.flatnonzero(loose < 0))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(stay) for c in names[:5]), pa.array(sequence).take(stay), pa.array(offset).take(stay)], names)
            row, out = [], []
            for i in np.flatnonzero(loose >= 0).tolist():
                raw, n, start = b.column("ids")[i].as_py(), int(length[i]), b.column("start")[i].as_py()
                ids, done = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4"), 0
                for s, o, size in plan.cuts(int(loose[i]), n):
                    row.append(i)
                    out.append((start + done, size, zlib.crc32(ids[done : done + size].tobytes()), s, o))
                    done += size
            if out:
                row, cols = pa.array(row), [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), *cols[:3], b.column("doc_tokens").take(row), *cols[3:]], names)

    ranked = rests.join(before, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"), "ids")
    whole = pieces.where(F.col("length") == capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(ranked.mapInArrow(place, COLUMNS))


def op11_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_histogram(table(spark, sf_dir, "documents"), default_path())
