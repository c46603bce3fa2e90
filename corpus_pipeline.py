"""A corpus pipeline: five stages, each applying one operator of ``quayside.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm.common import table, written
from quayside.llm.decontaminate import decontaminate
from quayside.llm.line_dedup import line_dedup
from quayside.llm.near_dup import near_dedup
from quayside.llm.packing import pack_sequences
from quayside.llm.tokenize import default_path
from quayside.llm.toxicity import drop_toxic

def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs).drop("n_lines_cut")


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_sequences(docs, default_path())


#: Each takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
STAGES = [
    ("toxicity", _toxicity),
    ("line_dedup", _lines),
    ("near_dedup", _near),
    ("decontamination", _benchmark),
    ("packing", _pack),
]
#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
