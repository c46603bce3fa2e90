"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str = "stream") -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Only where the setting is missing and everything runs in one process a temporary folder takes its place; on a
    cluster that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quayside-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: later steps survive lost executors."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` by ``columns`` over all shuffle partitions: as their number is given, few bytes with much work in them aren't put together
    in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
