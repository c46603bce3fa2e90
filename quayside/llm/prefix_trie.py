"""Operator 12: the prefix trie of conversations, by collapsing whole sequences.

A node is a distinct sequence of first turns, named by its depth and 128 bits: the exclusive or of its turns' hashes, each taken with
the turn's number.  Such names are running quantities, so a conversation of any length is spread over tasks: the
turns are dealt by range of (conv_id, turn), summed up inside a task's part of a conversation, and one row for each part
carries the sums on.

Conversations of one whole sequence collapse into one, the smallest, with a weight.  Sequences that are no proper
prefix of others (an anti-join against the distinct proper prefixes) are the leaves.  All numbers of a node are then sums over the
weighted prefixes:

* Every node belongs to the smallest conversation through it; what a conversation owns is its path from some depth
  ``own`` on.  A child counts for its parent in its owner's row, a leaf in its own.
* ``saved_tokens`` of a subtree is the words of all turns in it less those of its nodes, each counted in its owner's row: by row the
  weighted words from that depth on less the owned ones, both differences of running sums.

Lists of conversations that end at a node are hashed as streams: sorted by range, joined into short strings where they
lie, and only these strings of a node go through one hash, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, table, text_of, written

#: Conversations in a block share the first turns of the block's first one, up to BASE - 1 of them.
BLOCK, BASE = 20, 4
#: Rows of one turn come by so many first characters of role and text, then by hash.
ROLE_KEY, TEXT_KEY = 16, 32
#: Bytes of conv_ids joined before they are hashed.
CHUNK = 4096
NAME = ["depth", "x", "y"]


def head_turns(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from its block's first."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % BASE).cast("long")


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, idx (number of the turn from 0), a, b (128 bits of role and text), words."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    named = rows.select("*", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"))
    # the draw parts equal rows of one turn, however many there are
    keys = named.withColumns({"__role": F.substring("role", 1, ROLE_KEY), "__text": F.substring("text", 1, TEXT_KEY), "__draw": F.rand(12)})
    order = ["conv_id", F.col("turn").asc_nulls_first(), "__role", "__text", "a", "b", "__draw"]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = written(dealt.select("conv_id", F.monotonically_increasing_id().alias("place"), "a", "b", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")), "turns")
    turns = turns.withColumn("part", F.shiftright("place", 33))
    along = Window.partitionBy("conv_id", "part").orderBy("place")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task that holds a part of the conversation
    carried = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = turns.withColumn("here", F.row_number().over(along) - 1).join(carried, ["conv_id", "part"])
    return written(ranked.select("conv_id", "part", (F.col("before") + F.col("here")).alias("idx"), "a", "b", "words"), "ranked")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations as rows (conv_id, part, depth from 1, a, b, words), and all conv_ids."""
    first = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("idx") < BASE - 1))
    base = first.groupBy(F.col("conv_id").alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "a", "b", "words"))).alias("base"))
    parts = turns.groupBy("conv_id", "part").agg(F.min("idx").alias("first")).withColumn("h", head_turns(F.col("conv_id")))
    parts = parts.withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).join(base, "block", "left")
    parts = parts.withColumn("taken", F.when(F.col("base").isNotNull(), F.slice("base", F.lit(1), F.col("h").cast("int"))).otherwise(F.expr("slice(base, 1, 0)")))
    parts = parts.withColumn("k", F.coalesce(F.size("taken"), F.lit(0)).cast("long")).withColumn("k", F.greatest("k", F.lit(0).cast("long")))
    own = turns.join(parts.select("conv_id", "part", "h", "k"), ["conv_id", "part"]).where("idx >= h")
    own = own.select("conv_id", "part", (F.col("k") + F.col("idx") - F.col("h") + 1).alias("depth"), "a", "b", "words")
    shared = parts.where("first = 0").select("conv_id", F.lit(-1).cast("long").alias("part"), F.posexplode("taken").alias("pos", "t"))
    shared = shared.select("conv_id", "part", (F.col("pos") + 1).cast("long").alias("depth"), "t.a", "t.b", "t.words")
    return own.unionByName(shared), parts.where("first = 0").select("conv_id")


def prefixes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row with the running name and words inside its part; and what each part carries in and the conversation's totals."""
    along = Window.partitionBy("conv_id", "part").orderBy("depth")
    hashes = {c: F.xxhash64(F.lit(k), "depth", "a", "b") for k, c in enumerate("xy", 1)}
    local = rows.withColumns(hashes).select("conv_id", "part", "depth", "words", *(F.bit_xor(c).over(along).alias(c) for c in "xy"), F.sum("words").over(along).alias("w"))
    local = written(local, "prefixes")
    sums = local.groupBy("conv_id", "part").agg(*(F.max_by(c, "depth").alias(c) for c in "xyw"), F.max("depth").alias("n"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = sums.select(
        "conv_id", "part", *(F.coalesce(F.bit_xor(c).over(before), zero).alias(f"c{c}") for c in "xy"), F.coalesce(F.sum("w").over(before), zero).alias("cw"),
        *(F.bit_xor(c).over(whole).alias(f"all_{c}") for c in "xy"), F.sum("w").over(whole).alias("all_w"), F.max("n").over(whole).alias("n"))
    return local, written(carried, "carried")


def joined_ids(ends: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256 of the rising, comma-joined conv_ids of each name in ``ends`` (depth, x, y, conv_id)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size, first = None, [], 0, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, first, ",".join(held))], [*NAME, "first", "ids"])

        for b in batches:
            for *name, conv_id in zip(*(b.column(c).to_pylist() for c in (*NAME, "conv_id")), strict=True):
                if name != last or size > CHUNK:
                    if held:
                        yield row()
                    last, held, size, first = name, [], 0, conv_id
                held.append(str(conv_id))
                size += len(held[-1]) + 1
        if held:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, sha.hexdigest())], [*NAME, "ends_sha256"])

        for b in batches:
            for *name, ids in zip(*(b.column(c).to_pylist() for c in (*NAME, "ids")), strict=True):
                if name != last:
                    if last is not None:
                        yield row()
                    last, sha = name, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if last is not None:
            yield row()

    place = [*NAME, "conv_id"]
    short = ends.select(place).repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(chunks, "depth long, x long, y long, first long, ids string")
    return short.repartition(*NAME).sortWithinPartitions(*NAME, "first").select(*NAME, "ids").mapInArrow(digests, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt ``conversations`` (conv_id, turn, role, text).

    Null role and text are empty, null turns come first, rows of one turn come by role and text (by their first 16 and 32 characters,
    then by hash), repeated rows are turns each.  Rows without conv_id belong to no conversation.  Empty texts
    have no words; very long ones are only hashed and counted.  Without conversations there is no node, not even a root.  Other columns are ignored.
    """
    rows, ids = rebuilt(sorted_turns(conversations))
    local, carried = prefixes(rows)
    zero = F.lit(0).cast("long")
    totals = carried.groupBy("conv_id").agg(F.first("n").alias("depth"), F.first("all_x").alias("x"), F.first("all_y").alias("y"), F.first("all_w").alias("all_w"))
    ends = written(ids.join(totals, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in (*NAME, "all_w"))), "ends")
    # whole-sequence collapse: the smallest conversation of each sequence stands for all
    kept = written(ends.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.min("all_w").alias("all_w")), "sequences")
    stands = kept.select("conv_id", "weight")
    parts = carried.join(stands, "conv_id")
    paths = local.join(parts.select("conv_id", "part", "cx", "cy", "cw", "n", "weight"), ["conv_id", "part"]).select(
        "conv_id", "part", "depth", "words", F.col("x").bitwiseXOR(F.col("cx")).alias("x"), F.col("y").bitwiseXOR(F.col("cy")).alias("y"), (F.col("w") + F.col("cw")).alias("upto"), "n", "weight")
    paths = written(paths, "paths")

    known = written(paths.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.max(F.col("depth") < F.col("n")).alias("inner")), "names")
    leaves = kept.where("depth > 0").join(known.where("inner").select(NAME), NAME, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    owned = known.groupBy("conv_id").agg(F.min("depth").alias("own"))
    forks = paths.join(owned.select("conv_id", (F.col("own") - 1).alias("depth")), ["conv_id", "depth"]).select("conv_id", F.col("upto").alias("fork_w"), F.col("x").alias("px"), F.col("y").alias("py"))
    facts = kept.select("conv_id", "all_w").join(owned, "conv_id", "left").join(leaves, "conv_id", "left").join(forks, "conv_id", "left")
    facts = carried.select("conv_id", "part").join(facts, "conv_id")

    full = paths.join(facts, ["conv_id", "part"])
    onward = F.col("all_w") - F.col("upto") + F.col("words")
    mine = F.when(F.col("own").isNull(), zero).when(F.col("depth") >= F.col("own"), onward).otherwise(F.col("all_w") - F.coalesce("fork_w", zero))
    child = ((F.col("depth") < F.col("n")) & (F.col("own") <= F.col("depth") + 1)).cast("long")
    nodes = full.groupBy(*NAME).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.coalesce(child, zero)).alias("n_children"), F.sum(F.coalesce("leaf", zero)).alias("n_leaves"),
        F.sum(F.col("weight") * onward - mine).alias("saved_tokens"), *(F.min_by(c, "conv_id").alias(c) for c in ("own", "px", "py")))
    nodes = written(nodes, "nodes")

    # the root, from its children and from all conversations
    below = nodes.where("depth = 1").select("n_leaves", "saved_tokens", F.lit(1).cast("long").alias("n_children"), zero.alias("n_convs"), F.lit(None).cast("long").alias("conv_id"))
    every = ends.select(zero.alias("n_leaves"), zero.alias("saved_tokens"), zero.alias("n_children"), F.lit(1).cast("long").alias("n_convs"), "conv_id")
    root = below.unionByName(every).agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))).where("n_convs > 0")
    root = written(root.select(*(zero.alias(c) for c in NAME), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens"), "root")
    top = root.first()  # one row

    numbers = [*NAME, "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inside = nodes.where("depth > own or depth = 1").withColumn("parent_conv_id", F.when(F.col("depth") > F.col("own"), F.col("conv_id")).otherwise(F.lit(top["conv_id"] if top else None).cast("long")))
    # where an owner's path begins below the first turn, its parent is another's: as many rows meet a name as it has children
    begins = nodes.where("depth = own and depth > 1").withColumn("above", F.col("depth") - 1)
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("above"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("meet"))
    begins = hot_join(begins, parents, ["above", "px", "py"], "meet")
    every = inside.select(*numbers, "parent_conv_id").unionByName(begins.select(*numbers, "parent_conv_id")).unionByName(root.select(*numbers, "parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return every.join(joined_ids(ends), NAME, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
