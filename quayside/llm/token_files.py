"""Operator 4: token ids as length-delimited binary records with an offset index.

A shard is a row of records.  A record is

    length of the payload       unsigned 64 bits
    masked CRC-32 of the length unsigned 32 bits
    payload                     id flag and id (1 + 8 bytes), width of a token (1 byte), tokens
    masked CRC-32 of the payload

all little-endian; tokens take 2 bytes if all of them fit, else 4.  A checksum is masked by rotating it
right by 15 bits and adding 0xA282EAD8, so that checksums of data that hold checksums stay
sound.  Shards hold rising doc_ids.  The index is a Parquet table beside them with each record's
shard, offset, length and number of tokens: a reader can seek any record, in any order.

Shards are written by tasks through Arrow file systems (file, hdfs, s3, ...) under an attempt's name
and renamed when complete, so a task that runs again replaces its own shard and nothing else.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table, text_of
from .tokenize import default_path, token_ids

MASK = 0xA282EAD8
END = 2
#: Read at once from a shard.
BUFFER = 1 << 20
#: Bytes of text in a shard, about; there are at least as many shards as shuffle partitions.
SHARD = 256 << 20

INDEX = "shard int, file string, doc_id long, offset long, length long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def pack(doc_id: int | None, ids: bytes) -> bytes:
    """Payload of a sequence whose ids are little-endian unsigned 32-bit integers."""
    tokens = np.frombuffer(ids, "<u4")
    width = 2 if not len(tokens) or tokens.max() < 1 << 16 else 4
    return struct.pack("<?qB", doc_id is not None, doc_id or 0, width) + (tokens.astype("<u2").tobytes() if width == 2 else ids)


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    has_id, doc_id, width = struct.unpack_from("<?qB", payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def read_record(stream) -> bytes | None:
    """The next payload, or None at the end; a torn or damaged record is an error."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    n = struct.unpack("<Q", head[:8])[0]
    payload, check = stream.read(n), stream.read(4)
    if len(payload) < n or len(check) < 4 or masked(payload) != struct.unpack("<I", check)[0]:
        raise ValueError("damaged record payload")
    return bytes(payload)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> DataFrame:
    """Encodes every row of ``docs`` (doc_id, text) into shards under ``path``; returns the index, read from there.

    Null text counts as empty (its sequence is the end id alone).  Rows without doc_id come
    first, repeated doc_ids stay repeated records, other columns are ignored.  An empty table has an empty index.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    last = np.array([end], "<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        shard = context.partitionId()
        files, root = filesystem(path)
        name, attempt = f"{root}/shard-{shard:06d}.rec", f"{root}/.shard-{shard:06d}.{context.taskAttemptId()}"
        out, at, encoder = None, 0, token_ids(tokenizer)
        for b in batches:
            if out is None:
                files.create_dir(root)
                out = files.open_output_stream(attempt)
            rows = []
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                for doc_id, ids in zip(part["doc_id"], encoder.encode(part["text"].tolist()), strict=True):
                    ids += last
                    record = frame(pack(None if doc_id is None else int(doc_id), ids))
                    out.write(record)
                    rows.append((shard, name.rpartition("/")[2], doc_id, at, len(record), len(ids) // 4))
                    at += len(record)
            yield pd.DataFrame(rows, columns=["shard", "file", "doc_id", "offset", "length", "n_tokens"])
        if out is not None:
            out.close()
            files.move(attempt, name)

    ordered = docs.select("doc_id", text_of().alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    index = ordered.select(F.col("doc_id").cast("string"), "text").mapInPandas(write, INDEX.replace("doc_id long", "doc_id string"))
    index.withColumn("doc_id", F.col("doc_id").cast("long")).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_token_files(index: DataFrame, path: str) -> DataFrame:
    """Reads whole shards back, in file order: doc_id, start, n_tokens, ids_crc32."""
    totals = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("total"))
    # one row for each shard: a small table, whatever the corpus
    base = totals.withColumn("base", F.sum("total").over(Window.orderBy("shard")) - F.col("total"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = filesystem(path)
        for b in batches:
            for file, start in zip(b["file"], b["base"], strict=True):
                rows = []
                with files.open_input_stream(f"{root}/{file}", buffer_size=BUFFER) as stream:
                    while (payload := read_record(stream)) is not None:
                        doc_id, ids = unpack(payload)
                        rows.append((None if doc_id is None else str(doc_id), int(start), len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each shard: shards are of one size
    found = base.select("file", "base").repartition(max(1, totals.count())).mapInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_records(rows: DataFrame, path: str) -> DataFrame:
    """Seeks the records of ``rows`` of the index, in the order in which they come: doc_id, ids."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = filesystem(path)
        open_files: dict = {}
        for b in batches:
            out = []
            for file, offset in zip(b["file"], b["offset"], strict=True):
                if file not in open_files:
                    if len(open_files) > 50:
                        open_files.pop(next(iter(open_files))).close()
                    open_files[file] = files.open_input_file(f"{root}/{file}")
                stream = open_files[file]
                stream.seek(int(offset))
                doc_id, ids = unpack(read_record(stream))
                out.append((None if doc_id is None else str(doc_id), ids.astype(int).tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "ids"])

    return rows.select("file", "offset").mapInPandas(read, "doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in an order drawn from ``seed``: what a training epoch reads through ``read_records``."""
    return index.withColumn("draw", F.xxhash64("shard", "offset", F.lit(seed))).orderBy("draw").drop("draw")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    index = write_token_files(table(spark, sf_dir, "documents"), path, default_path())
    return read_token_files(index, path)
