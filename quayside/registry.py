"""Named queries over the tables of a folder, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evaluation, features, feeds, labels, market, metadata, models, report_set, research, streams

FAMILIES = (market, features, metadata, evaluation, feeds, labels, research, models, report_set, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.lead_lag_features(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in FAMILIES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in FAMILIES for name, (_, sql) in m.QUERIES.items() if sql}
