"""Helpers that the operators share: shared folders, table reading, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and everything runs in one process a temporary folder takes its place; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_base(spark)}/quayside-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage
    and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> F.Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Keys that hold more than this share of the rows are joined by broadcast: there are at most as many.
HOT_SHARE = 1000


def hot_join(detail: DataFrame, small: DataFrame, on: list[str], n: str, share: int = HOT_SHARE) -> DataFrame:
    """Inner join of ``detail`` with ``small``, which has one row a key and in ``n`` how many rows of ``detail`` the key has.

    A key may hold a third of all rows.  Keys with over 1/``share`` of them are at most ``share`` rows of ``small``, whatever
    the size, and are broadcast, so their rows stay spread as they are; all others meet in a shuffle.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = small.where(F.col(n) * share > total).withColumn("__hot", F.lit(True))
    added = [c for c in small.columns if c not in on]
    marked = detail.join(F.broadcast(hot), on, "left")
    columns = [*detail.columns, *added]
    cold = marked.where("__hot is null").drop("__hot", *added).join(small.where(F.col(n) * share <= total), on)
    return marked.where("__hot").select(columns).unionByName(cold.select(columns))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Smallest reachable node for each node of undirected ``edges`` (a long, b long).

    Alternating large-star and small-star steps: every step is one grouped minimum and
    one join, rows never exceed the edges, and a hot node's neighbours stay rows (no list
    is gathered), spread as they were.  Ends when a full round changes nothing.  Returns (node, root); nodes
    without edges don't appear.
    """

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("n")).where("n > 0")
        least = written(least.select("a", F.least("a", "m").alias("m"), "n"), name)
        return hot_join(both.where("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), name)
        linked = hot_join(down, least, ["a"], "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    edges = written(edges.where("a <> b").select("a", "b").distinct(), name)
    last = None
    while (now := mark(edges)) != last:
        last = now
        if not now[0]:
            break
        edges = written(small_star(written(large_star(edges), name)), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
