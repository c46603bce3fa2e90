"""Operator 10: repeated line runs by a suffix array over line ids, in DataFrame functions only.

A document is its sequence of non-blank lines.  Prefix doubling ranks every suffix by its
first 1, 2, 4, ... lines; a level keeps only suffixes whose prefix occurs elsewhere too, so
each rank left is an interval of the suffix array with a longest common prefix of at least
that many lines.  Ranks follow a range-partitioned sort, so no task sees a whole level, and
a pair of ranks that a third of all suffixes share is one row after the partial aggregation.

The shortest runs of at least ``min_words`` words that begin and that end at each line are looked up in those
intervals: two ranks, of its first and of its last power-of-two lines, name a run.  Where the
same run begins earlier (in an earlier document, or before it in the same one without
overlap), all its lines are deleted.  A line of a maximal
repeated run has ``min_words`` words of it from there on, or up to there, or lies in the
shortest run from its first line: both kinds together cover exactly the maximal runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, hot_join, table, text_of, written

#: Words that a repeated run must have before its later copies go.
MIN_WORDS = 50


def _key(text: str = "text"):
    """Names a row by 128 bits of id and text: repeated rows are one document and get the same verdict."""
    return F.struct(F.xxhash64("doc_id", text_of(text)).alias("a"), F.xxhash64(F.lit(1), "doc_id", text_of(text)).alias("b"))


def line_table(docs: DataFrame) -> DataFrame:
    """key, doc_id, seq (place among non-blank lines), raw (place among all), h1, h2, words."""
    lines = F.transform(F.split(text_of(), "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("raw")))
    lines = F.filter(lines, lambda s: F.btrim(s["line"], F.lit(SPACES)) != "")
    at = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), _key().alias("key"), F.posexplode(lines).alias("seq", "l"))
    # words of a trimmed line: white-space runs plus one
    words = F.size(F.split(F.btrim("l.line", F.lit(SPACES)), r"[ \t-\r]+", -1))
    return at.select("key", "doc_id", "seq", "l.raw", F.xxhash64("l.line").alias("h1"), F.xxhash64("l.line", F.lit(1)).alias("h2"), words.alias("words"))


def _ranked(pairs: DataFrame, name: str) -> DataFrame:
    """Distinct pairs (r1, r2), and how many suffixes have each (n), with a rank in their order: range partitions hold rising ids."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartitionByRange(n, "r1", "r2").sortWithinPartitions("r1", "r2")
    return written(ordered.withColumn("rank", F.monotonically_increasing_id()), name)


def _level(suffixes: DataFrame, name: str) -> DataFrame:
    """Suffixes (key, ..., r1, r2) whose pair occurs twice or more, with its rank."""
    pairs = suffixes.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1")
    return hot_join(suffixes, _ranked(pairs, f"{name}-ranks"), ["r1", "r2"], "n").drop("r1", "r2", "n")


def _doubled(level: DataFrame, step: int) -> DataFrame:
    """Pairs the rank at a place with the rank ``step`` lines later in the same document.

    A suffix without such a successor at this level either ends there or goes on as no
    other does: in both cases no run of twice the length begins at it that another repeats.
    """
    w = Window.partitionBy("key").orderBy("seq").rangeBetween(step, step)
    return level.withColumn("r2", F.first("rank").over(w)).where("r2 is not null").withColumnRenamed("rank", "r1")


def shortest_runs(first: DataFrame, min_words: int) -> DataFrame:
    """key, doc_id, seq, len: place and lines of the shortest runs of repeated lines from each line of
    first (key, doc_id, seq, words, ...) and up to it with ``min_words`` words, if there are any.  A line has a word,
    so at most ``min_words`` lines are looked at."""
    runs = _shortest(first, min_words, 1)
    # a line with all the words is the same run both ways
    return runs.unionByName(_shortest(first, min_words, -1).where("len > 1")).distinct()


def _shortest(first: DataFrame, min_words: int, way: int) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.col("seq") * way).rangeBetween(0, min_words - 1)
    ahead = first.withColumn("ahead", F.when(F.col("words") < min_words, F.collect_list(F.struct("seq", "words")).over(w)))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
    grown = F.aggregate(
        "ahead",
        zero,
        lambda a, x: F.when((a["sum"] < min_words) & (x["seq"] == F.col("seq") + a["n"] * way), F.struct((a["n"] + 1).alias("n"), (a["sum"] + x["words"]).alias("sum"))).otherwise(a),
    )
    ahead = ahead.withColumn("grown", grown)
    length = F.when(F.col("words") >= min_words, 1).when(F.col("grown.sum") >= min_words, F.col("grown.n"))
    ahead = ahead.withColumn("len", length).where("len is not null")
    return ahead.select("key", "doc_id", (F.col("seq") if way > 0 else F.col("seq") - F.col("len") + 1).alias("seq"), "len")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """key, seq, len of each shortest run that begins earlier elsewhere; and the repeated lines."""
    lines = line_table(docs)
    twice = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    ids = _ranked(twice.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "n"), "lines-ids")
    first = hot_join(lines.withColumnsRenamed({"h1": "r1", "h2": "r2"}), ids, ["r1", "r2"], "n").drop("r1", "r2", "n")
    first = written(first.dropDuplicates(["key", "seq"]), "lines-1")
    starts = written(shortest_runs(first, min_words), "lines-runs")
    longest = starts.agg(F.max("len")).first()[0] or 0

    found, level, step = [], first.select("key", "seq", "doc_id", "rank"), 1
    while step <= longest:
        here = starts.where((F.col("len") >= step) & (F.col("len") < 2 * step)).select("key", "seq", "doc_id", "len")
        named = here.join(level.select("key", "seq", F.col("rank").alias("r1")), ["key", "seq"])
        if step == 1:
            named = named.withColumn("r2", F.col("r1"))
        else:
            tail = level.select("key", F.col("seq").alias("at"), F.col("rank").alias("r2"))
            named = named.withColumn("at", F.col("seq") + F.col("len") - step).join(tail, ["key", "at"]).drop("at")
        found.append(named.select("key", "seq", "doc_id", "len", "r1", "r2", F.lit(step).alias("step")))
        if 2 * step <= longest:
            level = written(_level(_doubled(level, step), f"lines-{2 * step}"), f"lines-{2 * step}")
        step *= 2
    if not found:
        return starts.select("key", "seq", "len"), first
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    runs = written(runs, "lines-named")
    place = F.struct("doc_id", "key", "seq")
    ranges = written(runs.groupBy("step", "len", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "lines-ranges")
    later = hot_join(runs, ranges, ["step", "len", "r1", "r2"], "n")
    apart = (F.col("first.key") != F.col("key")) | (F.col("first.seq") + F.col("len") <= F.col("seq"))
    return later.where(apart & (F.col("first") < place)).select("key", "seq", "len"), first


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key, gone: sorted places (among all lines) of the lines that go, for documents that lose any."""
    runs, first = repeated_runs(docs, min_words)
    gone = runs.select("key", F.explode(F.sequence("seq", F.col("seq") + F.col("len") - 1)).alias("seq")).distinct()
    return gone.join(first.select("key", "seq", "raw"), ["key", "seq"]).groupBy("key").agg(F.sort_array(F.collect_list("raw")).alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from ``text``, plus n_lines_cut.

    Every row stays, with all its columns; a text that loses all its lines becomes empty.
    Null text stays null and has no lines; blank lines belong to no run and stay.  Rows that
    repeat both id and text count as one document; rows with a null doc_id come last in the
    order that decides which copy is the first.  An empty table stays empty.  A column n_lines_cut that ``docs``
    already has is replaced; other names don't clash.
    """
    docs = docs.drop("n_lines_cut")
    gone = written(deleted_lines(docs, min_words), "lines-gone").withColumnsRenamed({"key": "__line_key", "gone": "__line_gone"})
    # always a merge join: a broadcast of what goes would have no bound
    joined = docs.withColumn("__line_key", _key()).join(gone.hint("merge"), "__line_key", "left")
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_gone"))
    kept = F.array_join(F.transform(F.array(lines), lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")), "")
    cut = joined.withColumn("text", F.when(F.col("__line_gone").isNull(), F.col("text")).otherwise(kept))
    cut = cut.withColumn("n_lines_cut", F.coalesce(F.size("__line_gone"), F.lit(0)))
    return cut.select(*docs.columns, "n_lines_cut")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
