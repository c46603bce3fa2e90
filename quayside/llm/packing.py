"""Operator 8: best-fit packing by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut; full pieces are sequences already.  The others are
dealt evenly into regions of about ``REGION`` pieces.  Each region is packed by ``ISLANDS``
populations, each a task of its own, whose genes are whole bins: crossover injects the
best-filled bins of one parent into another, drops the bins that now hold a piece twice, and
puts their displaced pieces back best-fit.  Between epochs every island's elite migrates to its
neighbour.  The best solution of a region stands; pieces of its badly filled bins are dealt
into fewer, new regions and packed again, which stands if it needs fewer bins.  A region at the lower bound (total length over capacity)
stops at once.  Everything is drawn from seeds of region and island, so a task that runs again
finds the same packing.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, written
from .tokenize import default_path, token_ids

CAPACITY = 2048
END = 0
REGION = 2000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
#: Children of an epoch at most, and how many may follow each other without a better best.
GENERATIONS, PATIENCE = 60, 15
#: Bins filled less are opened again in the last round.
WELL_FILLED = 0.98

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Packing:
    """Bins of piece numbers and an index of bins by free room."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.bins: dict[int, list[int]] = {}
        self.free: dict[int, int] = {}
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some bin has exactly r free (stale entries are skipped)
        self.next = 0

    def copy(self) -> Packing:
        new = Packing(self.lengths, self.capacity)
        for items in self.bins.values():
            new.add(items)
        return new

    def _index(self, b: int) -> None:
        room = self.free[b]
        self.by_room[room].append(b)
        self.mask |= 1 << room

    def add(self, items: list[int]) -> None:
        b = self.next
        self.next += 1
        self.bins[b] = list(items)
        self.free[b] = self.capacity - sum(self.lengths[i] for i in items)
        self._index(b)

    def remove(self, b: int) -> list[int]:
        del self.free[b]
        return self.bins.pop(b)

    def insert(self, items: list[int]) -> None:
        """Best fit, longest first."""
        for i in sorted(items, key=lambda i: (-self.lengths[i], i)):
            self.best_fit(i)

    def best_fit(self, i: int) -> None:
        need = self.lengths[i]
        while rest := self.mask >> need:
            room = need + (rest & -rest).bit_length() - 1
            stack = self.by_room[room]
            while stack and self.free.get(stack[-1]) != room:
                stack.pop()
            if not stack:
                self.mask &= ~(1 << room)
                continue
            b = stack.pop()
            self.bins[b].append(i)
            self.free[b] = room - need
            self._index(b)
            return
        self.add([i])

    def fitness(self) -> float:
        """Mean square of the fills: few bins, and full ones."""
        if not self.bins:
            return 1.0
        return sum((1 - f / self.capacity) ** 2 for f in self.free.values()) / len(self.bins)

    def genes(self) -> np.ndarray:
        """The bin number of each piece, counted from 0."""
        out = np.zeros(len(self.lengths), "<i4")
        for k, items in enumerate(self.bins.values()):
            out[items] = k
        return out


def from_genes(genes: np.ndarray, lengths: list[int], capacity: int) -> Packing:
    new, groups = Packing(lengths, capacity), {}
    for i, b in enumerate(genes.tolist()):
        groups.setdefault(b, []).append(i)
    for items in groups.values():
        new.add(items)
    return new


def first_packing(lengths: list[int], capacity: int, noise: float, rng: random.Random) -> Packing:
    new = Packing(lengths, capacity)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i] * (1 + noise * rng.uniform(-1, 1)), i)):
        new.best_fit(i)
    return new


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """A child of ``b`` with some of the best-filled bins of ``a``."""
    ranked = sorted(a.bins, key=lambda k: (a.free[k], rng.random()))
    count = max(1, int(len(ranked) * rng.uniform(0.2, 0.6)))
    injected = [a.bins[k] for k in ranked[:count]]
    inside = {i for items in injected for i in items}
    child, displaced = Packing(b.lengths, b.capacity), []
    for items in injected:
        child.add(items)
    for items in b.bins.values():
        if inside.isdisjoint(items):
            child.add(items)
        else:
            displaced += [i for i in items if i not in inside]
    child.insert(displaced)
    return child


def mutate(a: Packing, rng: random.Random) -> Packing:
    """Opens the worst bins and a few others, and puts their pieces back."""
    child = a.copy()
    worst = sorted(child.bins, key=lambda k: -child.free[k])[: max(2, len(child.bins) // 50)]
    others = rng.sample(sorted(child.bins), min(len(child.bins), 2 * len(worst)))
    loose = [i for k in dict.fromkeys(worst + others) for i in child.remove(k)]
    child.insert(loose)
    return child


def evolve(lengths: list[int], seeds: list[np.ndarray], rng: random.Random, capacity: int = CAPACITY) -> Packing:
    """The best packing after ``GENERATIONS``, from given genes or from best-fit-decreasing starts."""
    bound = -(-sum(lengths) // capacity)
    people = [from_genes(g, lengths, capacity) for g in seeds]
    people.sort(key=lambda p: -p.fitness())
    if people and len(people[0].bins) <= bound:
        return people[0]
    while len(people) < POPULATION:
        people.append(first_packing(lengths, capacity, 0.0 if not people else 0.1 * len(people), rng))
        if len(people[-1].bins) <= bound:
            return people[-1]
    people.sort(key=lambda p: -p.fitness())
    waited = 0
    for _ in range(GENERATIONS):
        a, b = rng.sample(people[:POPULATION], 2)
        child = mutate(crossover(a, b, rng), rng)
        waited = 0 if child.fitness() > people[0].fitness() else waited + 1
        people[-1] = max(people[-1], child, key=Packing.fitness)
        people.sort(key=lambda p: -p.fitness())
        if len(people[0].bins) <= bound or waited > PATIENCE:
            break
    return people[0]


def pieces_of(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids, cut where longer than a sequence."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = token_ids(tokenizer)
        for b in batches:
            rows = []
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                for doc_id, ids in zip(part["doc_id"], encoder.encode(part["text"].tolist()), strict=True):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    found = docs.select(F.col("doc_id").cast("string"), text_of().alias("text")).mapInPandas(run, PIECES.replace("doc_id long", "doc_id string"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _round(items: DataFrame, number: int, capacity: int) -> DataFrame:
    """``items`` (item, length) with region, bin and fill, packed region by region."""
    n = items.count()
    regions = max(1, -(-n // REGION))
    parts = min(regions * ISLANDS, max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = items.withColumn("region", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(regions)).cast("int"))
    lone = dealt.select("region", "item", F.col("length").cast("int").alias("length"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        region, island = int(pdf["region"].iloc[0]), int(pdf["island"].iloc[0])
        lengths = pdf["length"].tolist()
        best = evolve(lengths, [], random.Random(f"{number}/{region}/{island}"), capacity)
        return pd.DataFrame({"region": [region], "island": [island], "lengths": [np.array(lengths, "<i4").tobytes()], "genes": [best.genes().tobytes()]})

    def go_on(pdf: pd.DataFrame) -> pd.DataFrame:
        region, island = int(pdf["region"].iloc[0]), int(pdf["island"].iloc[0])
        lengths = np.frombuffer(pdf["lengths"].iloc[0], "<i4").tolist()
        seeds = [np.frombuffer(g, "<i4") for g in sorted(pdf["genes"])]
        best = evolve(lengths, seeds, random.Random(f"{number}/{region}/{island}/{len(seeds)}"), capacity)
        return pd.DataFrame({"region": [region], "island": [island], "lengths": [pdf["lengths"].iloc[0]], "genes": [best.genes().tobytes()]})

    schema = "region int, island int, lengths binary, genes binary"
    state = lone.repartition(parts, "region", "island").groupBy("region", "island").applyInPandas(begin, schema)
    for _ in range(EPOCHS - 1):
        # each island's elite stays and also goes to the next island
        elites = state.withColumn("island", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)))
        state = elites.groupBy("region", "island").applyInPandas(go_on, schema)

    def settle(items: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("item").reset_index(drop=True)
        lengths = items["length"].to_numpy()
        best = min((np.frombuffer(g, "<i4") for g in sorted(states["genes"])), key=lambda g: (g.max(), -np.square(np.bincount(g, lengths)).sum()))
        items["bin"] = best
        items["fill"] = np.bincount(best, lengths).astype(np.int64)[best]
        return items[["region", "item", "length", "bin", "fill"]]

    packed = dealt.groupBy("region").cogroup(state.groupBy("region")).applyInPandas(settle, "region int, item long, length long, bin int, fill long")
    return written(packed, f"packed-{number}")


def pack_sequences(docs: DataFrame, tokenizer: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``.

    Null text counts as empty: its piece is the end id alone.  Repeated rows are packed
    each; a null doc_id stays null; other columns are ignored.
    """
    pieces = written(pieces_of(docs, tokenizer, end, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    small = pieces.where(F.col("length") < capacity).select("item", "length")
    first = _round(small, 1, capacity)
    open_bins = F.col("fill") < WELL_FILLED * capacity
    second = _round(first.where(open_bins).select("item", "length"), 2, capacity)
    bins = lambda df: df.select("region", "bin").distinct().count()
    packed = [(1, first.where(~open_bins)), (2, second)] if bins(second) < bins(first.where(open_bins)) else [(1, first)]
    places = [df.select("item", "length", (F.lit(k << 60).cast("long") + F.col("region").cast("long") * (1 << 24) + F.col("bin")).alias("sequence_id")) for k, df in packed]

    # a sequence holds at most ``capacity`` pieces
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    placed = (places[0] if len(places) == 1 else places[0].unionByName(places[1])).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("length")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rest = pieces.where(F.col("length") < capacity).join(placed, "item")
    return full.select(columns).unionByName(rest.select(columns))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"), default_path())
