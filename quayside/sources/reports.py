"""Files that a run leaves: trades, results, and a log that only grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_trades(trades: DataFrame, path: str) -> None:
    """Trades as CSV with a header, one folder of part files."""
    trades.write.mode("overwrite").option("header", True).csv(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as JSON lines; null fields are left out."""
    results.write.mode("overwrite").json(path)


def log_experiment(results: DataFrame, run: str, path: str) -> None:
    """Appends the rows of one run; nothing that is there changes."""
    results.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
