"""Feature datasets by UTC day, keyed by the content of what they are built from.

A day lies under ``data/day=<day>/key=<key>``, so what was built from other inputs is neither replaced nor taken for it: going back
to inputs of before finds their days again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_KEY = "day string, key string"


def day_of(ts: str) -> F.Column:
    return F.date_format(F.timestamp_micros(F.expr(f"{ts} DIV 1000")), "yyyyMMdd")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """folder, name, length, sha256 of the content of the files below ``path``; each file is one task's row, up to 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def fingerprint(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """A digest of names, sizes and contents of the files below ``path``: folder by folder, then of the folders."""
    fold = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ";"), 256)
    folders = file_digests(spark, path, pattern).groupBy("folder").agg(fold(F.concat_ws("|", "name", F.col("length").cast("string"), "sha256")).alias("d"))
    return folders.agg(F.substring(fold(F.concat_ws("|", "folder", "d")), 1, 16)).first()[0]


def day_keys(inputs: DataFrame, ts: str = "ts_local_ns", halo: int = 0) -> DataFrame:
    """day, key: a digest of the content of each UTC day's rows, and of the ``halo`` days before it that a day's features look back on.

    Rows are hashed where they lie and the hashes added up, so neither their order nor their files matter.
    """
    columns = sorted(inputs.columns)
    lanes = [F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)")).cast("string") for k in (1, 2)]
    days = inputs.groupBy(day_of(ts).alias("day")).agg(F.concat_ws("|", F.count("*").cast("string"), *lanes).alias("rows"))
    # one row for each day
    seen = Window.orderBy("day").rowsBetween(-halo, 0)
    return days.select("day", F.substring(F.sha2(F.array_join(F.collect_list("rows").over(seen), ";"), 256), 1, 16).alias("key"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """day, key of all days built; a day is entered after its data are complete."""
    path = f"{root}/manifest"
    spark.createDataFrame([], DAY_KEY).write.mode("append").parquet(path)  # it exists from now on
    return spark.read.schema(DAY_KEY).parquet(path)


def write_days(df: DataFrame, root: str, keys: DataFrame, ts: str = "ts_ns") -> list[str]:
    """Builds the days of ``df`` whose (day, key) of ``keys`` isn't there yet; returns them."""
    spark = df.sparkSession
    # a day is one row here: the list is short
    fresh = sorted(tuple(r) for r in keys.join(manifest(spark, root), ["day", "key"], "left_anti").collect())
    if fresh:
        wanted = spark.createDataFrame(fresh, DAY_KEY)
        built = df.withColumn("day", day_of(ts)).where(F.col("day").isin([d for d, _ in fresh])).join(F.broadcast(wanted), "day")
        built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "key").parquet(f"{root}/data")
        wanted.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return [d for d, _ in fresh]


def read_days(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """The days of ``keys``, each as it was built for its key."""
    wanted = [tuple(r) for r in keys.join(manifest(spark, root), ["day", "key"], "left_semi").collect()]
    data = spark.read.option("recursiveFileLookup", False).parquet(f"{root}/data").withColumn("day", F.col("day").cast("string")).withColumn("key", F.col("key").cast("string"))
    return data.where(F.concat_ws("/", "day", "key").isin([f"{d}/{k}" for d, k in wanted])).drop("key")
