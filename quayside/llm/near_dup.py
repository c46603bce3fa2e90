"""Near-duplicates by exact Jaccard similarity of word shingles.

Texts with the same set of shingles are one node.  Candidates are named by operator 6: the SimHash fingerprints of the sets,
linked at two or fewer differing bits over their Golay-code keys.  A pair at the threshold differs in some ten of 64 bits,
which no radius of such keys reaches, so MinHash bands (``ROWS`` minima each, as many bands as
leave a pair at the threshold out with probability ``MISS`` at most) name the rest.  Each candidate pair
is verified on the whole sets.  What is linked over verified pairs is one component.

Bands with more than ``HOT`` nodes don't pair them all up: each node is compared with the band's pivot first, the node that
is in most such bands (of many changed copies, the text they were made from).  Of x and y, two nodes of the band, what they
share lies inside the pivot or outside it: at most the smaller of their overlaps with the pivot, plus the smaller of what
each has outside it that any other node of a hot band has at all.  Where that doesn't reach the threshold no pair is
formed; a node's sizes of possible partners follow from its own numbers, so the others meet by band and
size.  Pairs of one component need no further look, all the rest that may reach the threshold are verified, so no
link is lost, and a group of thousands of changed copies costs rows in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hot_join, text_of, written
from .simhash import SEED, fingerprint, links, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 4
MISS = 1e-6
#: Nodes of one band that are paired up directly.
HOT = 64
#: Shingles that meet all multipliers at once.
BLOCK = 4096


def _bands(similarity: float) -> int:
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def _multipliers(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(0, 2**64, (bands * ROWS, 1), dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def band_keys(shingles: np.ndarray, multipliers: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Signed keys of the bands of a set of shingles; none for the empty set."""
    if not len(shingles):
        return []
    times, flip = multipliers
    least = np.full(len(times), 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), BLOCK):
        least = np.minimum(least, ((shingles[a : a + BLOCK] ^ flip) * times).min(axis=1))
    rows = least.astype("<u8").reshape(-1, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - 2**63 for i, r in enumerate(rows)]


def _sets(b: pd.DataFrame, shingle: int) -> Iterator[np.ndarray]:
    for t in b["text"]:
        yield np.unique(np.array(shingle_hashes(t, shingle), np.uint64))


def _rid() -> tuple[F.Column, F.Column]:
    """Names a row by 128 bits of id and text."""
    return F.xxhash64("doc_id", text_of()).alias("rid"), F.xxhash64(F.lit(1), "doc_id", text_of()).alias("rid2")


def _signatures(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, rid and rid2, h1 and h2 (128 bits of the set), n (shingles of the set), fp (its fingerprint), keys."""
    bands = _bands(similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        multipliers = _multipliers(bands)
        for b in batches:
            rows = [(*(xxhash.xxh64_intdigest(s.tobytes(), k) - 2**63 for k in (0, 1)), len(s), fingerprint(s), band_keys(s, multipliers)) for s in _sets(b, shingle)]
            h1, h2, n, fp, keys = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"doc_id": b["doc_id"], "rid": b["rid"], "rid2": b["rid2"], "h1": h1, "h2": h2, "n": n, "fp": fp, "keys": keys})

    rows = docs.select(F.col("doc_id").cast("string"), *_rid(), text_of().alias("text"))
    return rows.mapInPandas(run, "doc_id string, rid long, rid2 long, h1 long, h2 long, n long, fp long, keys array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def _set_table(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node, set for the ``wanted`` nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "set": [s.view(np.int64) for s in _sets(b, shingle)]})

    rids = wanted.join(nodes.select("node", "rid", "rid2"), "node")
    texts = docs.select(*_rid(), text_of().alias("text")).join(rids.hint("merge"), ["rid", "rid2"]).dropDuplicates(["node"])
    return written(texts.select("node", "text").mapInPandas(run, "node long, set array<long>"), "near-sets")


def _enough(both, total, similarity: float):
    """Whether ``both`` shared shingles of sets with ``total`` together are similar enough."""
    return both >= similarity * (total - both) - 1e-9


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose sets are similar enough."""
    pairs = written(pairs, "near-pairs")
    sets = _set_table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, shingle)
    x, y = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    met = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return written(met.where(_enough(F.col("both"), F.col("sum"), similarity)).select("a", "b"), "near-links")


def _against_pivots(members: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """key, node, n, pivot, inside, outside: of each member of a hot band, how much of its set the band's pivot has, and how
    much of the rest any other member of a hot band has."""
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    ranked = members.join(degree, "node")
    pivots = ranked.groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("pivot"))
    told = written(members.join(pivots, "key"), "near-told")
    sets = _set_table(members.select("node").distinct(), nodes, docs, shingle)
    each = sets.select("node", F.explode("set").alias("s"))
    often = written(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "near-often")
    shared = hot_join(each, often, ["s"], "df").groupBy("node").agg(F.collect_list("s").alias("shared"))
    pairs = written(told.groupBy("pivot", "node").agg(F.count("*").alias("bands")), "near-pivots")
    own = sets.join(shared, "node", "left").select("node", "set", F.coalesce("shared", F.array().cast("array<long>")).alias("shared"))
    size = pairs.groupBy("pivot").agg(F.count("*").alias("rows"))
    heart = written(sets.withColumnsRenamed({"node": "pivot", "set": "heart"}).join(size, "pivot"), "near-hearts")
    met = hot_join(pairs.join(own.hint("merge"), "node"), heart, ["pivot"], "rows", 64)
    numbers = written(met.select("pivot", "node", F.size(F.array_intersect("set", "heart")).alias("inside"), F.size(F.array_except("shared", "heart")).alias("outside"), F.size("heart").alias("n_pivot")), "near-numbers")
    return told.join(numbers, ["pivot", "node"])


def _roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root for each of ``nodes``."""
    found = connected_components(edges, "near-cc")
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _bucket(n):
    """Sizes that differ by a hundredth share a bucket."""
    return F.floor(F.log(F.greatest(n, F.lit(1.0))) / 0.01).cast("int")


def _fuzzy_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints operator 6 links; nodes of one fingerprint meet its smallest."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("size"))
    least = written(least, "near-fps")
    same = hot_join(nodes.select("fp", "node"), least.where("size > 1"), ["fp"], "size").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    at = lambda end: least.select(F.col("fp").alias(end), F.col("least").alias(f"node_{end}"))
    linked = links(least.select("fp")).join(at("a"), "a").join(at("b"), "b")
    return same.unionByName(linked.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def near_links(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect all nodes that share a band and are similar enough, and of the pairs that operator 6 links those that are."""
    # the smaller set must hold ``similarity`` of the larger one
    alike = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(hot_join(keyed, written(counts, "near-counts"), ["key"], "size"), "near-keys")
    cold = shared.where(F.col("size") <= HOT)
    a = cold.select("key", F.col("node").alias("a"), F.col("n").alias("na"))
    b = cold.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "key").where("a < b").where(alike(F.col("na"), F.col("nb"))).select("a", "b")
    edges = _verified(pairs.unionByName(_fuzzy_pairs(nodes)).distinct(), nodes, docs, shingle, similarity)
    hot = shared.where(F.col("size") > HOT).select("key", "node", "n")
    if hot.isEmpty():
        return edges
    told = written(_against_pivots(hot, nodes, docs, shingle), "near-hot")
    tied = told.where("node <> pivot").where(_enough(F.col("inside"), F.col("n") + F.col("n_pivot"), similarity))
    edges = written(edges.unionByName(tied.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))).distinct(), "near-edges")
    roots = _roots(nodes, edges)
    cores = told.groupBy("pivot").agg(F.count("*").alias("rows")).join(roots.withColumnsRenamed({"node": "pivot", "root": "core"}), "pivot")
    placed = hot_join(told.join(roots, "node"), written(cores, "near-cores"), ["pivot"], "rows")
    placed = written(placed.select("key", "node", "n", "inside", "outside", "root", (F.col("root") != F.col("core")).alias("apart")), "near-placed")
    # shared / (n + partner - shared) reaches the similarity for partners up to this size only
    most = F.least(F.floor(F.col("n") / similarity + 1e-6), F.floor((1 + similarity) / similarity * (F.col("inside") + F.col("outside")) - F.col("n") + 1e-6))
    least = F.ceil(F.col("n") * similarity - 1e-6)
    apart = placed.where("apart").withColumns({"least": least, "most": most}).where("most >= least")
    sizes = F.explode(F.sequence(_bucket(F.col("least").cast("double")), _bucket(F.col("most").cast("double")))).alias("bucket")
    name = lambda df, s, *more: df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "inside", "outside", "root")], *more)
    x, y = name(apart, "x", sizes), name(placed, "y", _bucket(F.col("n").cast("double")).alias("bucket"))
    reach = F.least("inside_x", "inside_y") + F.least("outside_x", "outside_y")
    may = (F.col("root_x") != F.col("root_y")) & alike(F.col("n_x"), F.col("n_y")) & _enough(reach, F.col("n_x") + F.col("n_y"), similarity)
    more = x.join(y, ["key", "bucket"]).where(may).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    return edges.unionByName(_verified(more, nodes, docs, shingle, similarity))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id.

    Two rows are linked if the Jaccard similarity of their sets of ``shingle``-word runs is at least
    ``similarity``; a shorter text is one run, and texts without words are copies of each other.
    Rows that repeat a doc_id stay together; rows without doc_id are linked too, but kept.
    """
    sigs = written(_signatures(docs, shingle, similarity), "near-sigs")
    nodes = sigs.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min(F.struct("rid", "rid2")).alias("r"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("rows"))
    # written once, so a set keeps its number
    nodes = written(nodes.select("h1", "h2", "least", "r.rid", "r.rid2", "n", "fp", "keys", "rows", F.monotonically_increasing_id().alias("node")), "near-nodes")
    roots = _roots(nodes, near_links(nodes, docs, shingle, similarity))
    placed = nodes.select("node", "h1", "h2", "least", "rows").join(roots, "node")
    named = written(placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h1", "h2", "component_id", "rows"), "near-named")
    gone = hot_join(sigs.select("doc_id", "h1", "h2"), named, ["h1", "h2"], "rows").where("doc_id <> component_id").select("doc_id").distinct()
    # always a merge join: a broadcast of what goes would have no bound
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")
