"""Operator 5: WARC archives as a Spark data source in Python.

Written archives hold one gzip member for each record.  A member's header carries its compressed and
plain lengths in an ``sl`` field, so a reader steps from record to record without inflating
what it doesn't want; members of 4 GiB and more and those of other writers have no such field and are read by inflating.
Plain ``.warc`` files are read as they are.

The reader plans partitions of whole files up to ``partitionbytes`` each, or less where option ``parallelism``
tasks would otherwise not all have work; a writer begins a new file at that size, so no file is larger than a partition.  Comparisons of
record type and other header columns with constants are pushed down to it: it inflates a record's
first bytes, parses the WARC headers, tests them, and decodes the payload only of records that
pass, and only if option ``payload`` (give it back) or ``verify`` (hold it against its digest) asks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .common import hot_join, scratch, table, text_of, written

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length long, file string, offset long, payload binary"
#: Columns that headers alone decide.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_length")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: A writer begins the next file beyond this size, and a partition holds files up to it.
ROLL = 128 << 20
HEAD = 4096


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` whose block is the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to:
        head += [f"WARC-Refers-To: <{_clean(refers_to)}>", f"WARC-Profile: {SAME_PAYLOAD}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its lengths in an ``sl`` field."""
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(data)) < 1 << 32:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data))
    else:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_head(data: bytes) -> dict | None:
    """Header columns of the record that ``data`` begins with, its ``block`` start and length, or
    None if the headers don't end within ``data``."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block, http = end + 4, {}
    if fields.get("content-type", "").startswith("application/http"):
        http_end = data.find(b"\r\n\r\n", block)
        if http_end < 0:
            return None
        for line in data[block:http_end].decode("latin-1").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            http[name.strip().lower()] = value.strip()
        start = http_end + 4
    else:
        start = block
    size = int(fields.get("content-length", 0))
    held = block + size - start
    digest = fields.get("warc-payload-digest")
    bare = lambda x: x[1:-1] if x and x[0] == "<" else x
    return {
        "record_id": bare(fields.get("warc-record-id")),
        "record_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": digest.removeprefix("sha1:") if digest else None,
        "refers_to": bare(fields.get("warc-refers-to")),
        "payload_length": int(http.get("content-length", held)),
        "payload_at": start,
        "payload_held": held,
    }


def _inflate(data: bytes, limit: int = 0) -> tuple[bytes, int]:
    """What a gzip member holds, up to ``limit`` bytes (0: all), and where the member ends if that was reached; plain records as they are."""
    if data[:5] == b"WARC/":
        return data, len(data)
    d = zlib.decompressobj(31)
    out = d.decompress(data, limit) if limit else d.decompress(data)
    return out, (len(data) - len(d.unused_data) if d.eof else 0)


def read_members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of an open file: a gzip member, or a plain record."""
    at, rest = 0, b""

    def fill(total: int) -> None:
        nonlocal rest
        parts = [rest]
        missing = total - len(rest)
        while missing > 0:
            if not (more := stream.read(max(1 << 16, missing))):
                raise ValueError(f"torn record at {at}")
            parts.append(more)
            missing -= len(more)
        rest = b"".join(parts)

    while True:
        if len(rest) < 24:
            rest += stream.read(1 << 16)
        if not rest:
            return
        if rest[:5] == b"WARC/":
            while (end := rest.find(b"\r\n\r\n")) < 0:
                fill(len(rest) + 1)
            size = re.search(rb"^content-length:\s*(\d+)", rest[:end], re.I | re.M)
            if size is None:
                raise ValueError(f"no length of the record at {at}")
            total = end + 8 + int(size[1])
            fill(total)
        elif rest[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no record at {at}")
        elif rest[3] & 4 and rest[12:14] == b"sl":
            total = struct.unpack_from("<I", rest, 16)[0]
            fill(total)
        else:
            while not (total := _inflate(rest)[1]):
                fill(2 * len(rest))
        yield at, rest[:total]
        at, rest = at + total, rest[total:]


@dataclass
class Files(InputPartition):
    paths: list


@dataclass
class Wrote(WriterCommitMessage):
    moves: list


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


TESTS = {
    EqualTo: lambda v, x: v is not None and v == x,
    In: lambda v, x: v is not None and v in x,
    GreaterThan: lambda v, x: v is not None and v > x,
    GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x,
    LessThanOrEqual: lambda v, x: v is not None and v <= x,
    IsNull: lambda v, x: v is None,
    IsNotNull: lambda v, x: v is not None,
}


def _archives(files, root: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives in a folder, by name."""
    from pyarrow import fs

    return sorted((x.path, x.size) for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.path.endswith((".warc.gz", ".warc")))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.most = int(options.get("partitionbytes", ROLL))
        self.parallelism = int(options.get("parallelism", 1))
        self.tests: list = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in TESTS and len(column) == 1 and column[0] in HEADER_COLUMNS:
                self.tests.append((column[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        files, root = _files(self.path)
        found = _archives(files, root)
        most = min(self.most, max(1, sum(n for _, n in found) // self.parallelism))
        plans, size = [], most
        for path, n in found:
            if size + n > most:
                plans.append([])
                size = 0
            plans[-1].append(path)
            size += n
        return [Files(p) for p in plans] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = _files(self.path)
        for path in partition.paths:
            with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                for offset, data in read_members(stream):
                    limit = HEAD
                    while (head := parse_head(part := _inflate(data, limit)[0])) is None:
                        if len(part) < limit:
                            raise ValueError(f"no WARC headers at {path}:{offset}")
                        limit *= 4
                    if not all(TESTS[kind](head[c], x) for c, kind, x in self.tests):
                        continue
                    payload = None
                    if (self.payload or self.verify) and head["record_type"] != "revisit":
                        whole = part if len(part) < limit or data is part else _inflate(data)[0]
                        payload = whole[head["payload_at"] : head["payload_at"] + head["payload_held"]]
                        if self.verify and (len(payload) != head["payload_length"] or digest_of(payload) != head["payload_digest"]):
                            raise ValueError(f"payload differs from its digest at {path}:{offset}")
                    yield (*(head[c] for c in HEADER_COLUMNS), path.rpartition("/")[2], offset, payload if self.payload else None)


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (record_id, target_uri, payload, refers_to); files get their names at the commit, and no other job's: an append adds to
    what is there, an overwrite takes it away once its own files are complete."""

    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex[:12]
        files, root = _files(self.path)
        files.create_dir(root)  # at the driver: a table without rows is an empty folder

    def write(self, batches: Iterator) -> Wrote:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = _files(self.path)
        files.create_dir(root)
        moves, out, size = [], None, 0
        for b in batches:
            rows = zip(*(b.column(c) for c in ("record_id", "target_uri", "payload", "refers_to")), strict=True)
            for record_id, uri, payload, refers_to in rows:
                if out is None or size > ROLL:
                    if out is not None:
                        out.close()
                    base = f"part-{self.job}-{context.partitionId():06d}-{len(moves):04d}"
                    moves.append((f".{base}.{context.taskAttemptId()}", f"{base}.warc.gz"))
                    out, size = files.open_output_stream(f"{root}/{moves[-1][0]}", compression=None), 0
                data = member(record_bytes(record_id.as_py(), uri.as_py(), payload.as_py() or b"", refers_to.as_py()))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Wrote(moves)

    def commit(self, messages: list) -> None:
        files, root = _files(self.path)
        old = [p for p, _ in _archives(files, root)] if self.overwrite else []
        for p in old:
            files.delete_file(p)
        for m in messages:
            for a, b in m.moves if m else ():
                files.move(f"{root}/{a}", f"{root}/{b}")

    def abort(self, messages: list) -> None:
        files, root = _files(self.path)
        for m in messages:
            for a, _ in m.moves if m else ():
                files.delete_file(f"{root}/{a}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """record_id, target_uri, payload, refers_to for every row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``min_bytes`` the one with the smallest page_id is a
    response, the others revisit it.  Null html is an empty payload.  Rows that repeat a page_id and its
    payload are all responses if it is the smallest; a null page_id is always a response.  Other columns are ignored;
    an empty table gives no records.
    """
    html = text_of("html")
    keyed = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes)
    first = written(keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "payloads")
    again = hot_join(keyed, first, ["digest"], "copies").where("page_id <> first").select("page_id", "digest", "first").distinct()
    whole = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha1("html"))
    joined = whole.join(again.hint("merge"), ["page_id", "digest"], "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return joined.select(
        F.coalesce(name("page_id"), F.lit("urn:page:")).alias("record_id"), F.col("url").cast("string").alias("target_uri"),
        F.col("html").cast("binary").alias("payload"), name("first").alias("refers_to"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = scratch(spark, "warc")
    page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("payload", "false").option("verify", "true").option("parallelism", spark.sparkContext.defaultParallelism).load(path)
    back = back.where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.when(F.length(c) > 9, F.substring(c, 10, 40)).cast("long")
    return back.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))
