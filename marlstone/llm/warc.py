"""WARC archives and their chunked record table (operator 7).

``write_archives`` writes one record for each page: of equal payloads of at
least ``revisit_bytes`` the one with the largest id is a response and the
others are revisits of it. ``read_chunks`` streams archives back as rows of
record identifier and chunk number; each chunk carries the digest of the
payload up to its end, so a reader never holds a whole record, whatever its
length, and the last chunk has the whole payload's length and digest.

Files go through pyarrow.fs, so any file system that it knows will do. An
archive's name holds the task's attempt and nothing is ever renamed: a task that
is lost, or runs twice, writes archives of other names, and the table of archives
lists those of the attempt that Spark accepted. Records are gzip members; chunks
have CHUNK bytes but for a record's last one.

Null html is an empty payload. Rows that repeat a page id and its payload are
all responses if theirs is the largest id. Rows with a null id count as smaller
than all ids. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh_path, in_parts, materialize

CHUNK = 1 << 16
NL = b"\r\n"
CHUNKS = "archive string, record_no bigint, page_id bigint, record_type string, refers_to bigint, target_uri string, chunk_no bigint, chunk_bytes bigint, data binary, bytes_so_far bigint, sha1_so_far string, is_last boolean, digest_ok boolean"
PREFIX = "urn:page:"


def revisits(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """pages: page_id, url, html. Adds payload bytes and digest, record type and what it refers to."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary"))})
    keys = own.drop("html", "url").filter(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1")
    # one row for each repeated payload, written so that Spark sees its size: pages stay where they are, or a hot payload is split
    keys = materialize(keys, "payloads")
    joined = own.join(keys.select(F.col("payload_digest").alias("k_digest"), F.col("payload_bytes").alias("k_bytes"), "largest"), (F.col("payload_digest") == F.col("k_digest")) & (F.col("payload_bytes") == F.col("k_bytes")), "left")
    again = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("largest")).alias("refers_to"))


def record_head(row: dict[str, Any], payload: int, digest: str) -> bytes:
    """Header of the record and of the response in it; the payload follows unless it is a revisit."""
    again = row["record_type"] == "revisit"
    http = NL.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % payload, b"", b""])
    uri = "".join(ch if " " < ch != "\x7f" else f"%{ord(ch):02X}" for ch in row["url"] or "")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{PREFIX}{'' if row['page_id'] is None else row['page_id']}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if again:
        lines += [f"WARC-Refers-To: <{PREFIX}{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if again else payload)}", "", ""]
    return "\r\n".join(lines).encode() + http


def write_record(out: BinaryIO, row: dict[str, Any], payload: memoryview, digest: str, level: int = 1) -> None:
    """One gzip member, the payload in chunks."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out.write(z.compress(record_head(row, len(payload), digest)))
    if row["record_type"] != "revisit":
        for i in range(0, len(payload), CHUNK):
            out.write(z.compress(payload[i : i + CHUNK]))
    out.write(z.compress(NL + NL))
    out.write(z.flush())


def write_archives(spark: SparkSession, records: DataFrame, folder: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Writes the rows of ``revisits``; one row for each archive: its path and number of records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, part, done, out = TaskContext.get(), 0, 0, None

        def named() -> str:
            return f"part-{task.partitionId():06d}-{task.stageId()}-{task.taskAttemptId()}-{part:04d}.warc.gz"

        names: list[tuple[str, int]] = []

        def close() -> None:
            out.close()
            names.append((f"{folder}/{named()}", done))

        for batch in in_parts(batches):
            html = column(batch, "html").cast(pa.binary())
            heads = batch.drop_columns(["html"]).to_pylist()
            for row, payload in zip(heads, html, strict=True):
                if out is not None and out.tell() > max_bytes:
                    close()
                    part, done, out = part + 1, 0, None
                if out is None:
                    out = store.open_output_stream(f"{base}/{named()}", compression=None)
                write_record(out, row, memoryview(payload.as_buffer()), row["payload_digest"])
                done += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in names], pa.string()), pa.array([k for _, k in names], pa.int64())], names=["archive", "records"])

    return materialize(records.mapInArrow(write, "archive string, records bigint"), "archives")


class _Members:
    """Reads the bytes of one gzip member after the other, never more than asked for."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.z, self.pending, self.ready = raw, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        if self.z.eof:
            self.pending, self.z = self.z.unused_data, zlib.decompressobj(31)
        data = self.pending or self.raw.read(CHUNK)
        if not data:
            return False
        self.ready += self.z.decompress(data, CHUNK)
        self.pending = b"" if self.z.eof else self.z.unconsumed_tail
        return True

    def line(self) -> bytes:
        while NL not in self.ready:
            if not self.more():
                return b""
        out, self.ready = self.ready.split(NL, 1)
        return out

    def exactly(self, n: int) -> bytes:
        """The next n bytes, CHUNK at most."""
        while len(self.ready) < n:
            if not self.more():
                raise EOFError("the archive ends within a record")
        out, self.ready = self.ready[:n], self.ready[n:]
        return out

    def ended(self) -> bool:
        while not self.ready:
            if not self.more():
                return True
        return False


def _fields(members: _Members) -> dict[str, str]:
    out = {}
    while line := members.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix(PREFIX)
    return int(value) if value else None


def stream_chunks(raw: BinaryIO, archive: str, with_data: bool) -> Iterator[tuple]:
    members, number = _Members(raw), 0
    while not members.ended():
        if not members.line().startswith(b"WARC/"):
            raise ValueError(f"{archive}: record {number} doesn't begin with a version")
        head = _fields(members)
        block = int(head["content-length"])
        start = members.line()
        http = _fields(members)
        said, sha1, at, k = head["warc-payload-digest"].removeprefix("sha1:"), hashlib.sha1(), 0, 0
        size = int(http["content-length"])
        row = (archive, number, _page(head["warc-record-id"]), head["warc-type"], _page(head.get("warc-refers-to")), head["warc-target-uri"])
        if head["warc-type"] == "revisit":
            yield (*row, 0, 0, None, size, said, True, None)
        else:
            held = len(start) + 2 + sum(len(n) + len(v) + 4 for n, v in http.items()) + 2
            if block - held != size:
                raise ValueError(f"{archive}: record {number} has {block} bytes, not {held + size}")
            while True:
                data = members.exactly(min(CHUNK, size - at))
                at += len(data)
                sha1.update(data)
                last = at == size
                yield (*row, k, len(data), data if with_data else None, at, sha1.hexdigest(), last, sha1.hexdigest() == said if last else None)
                k += 1
                if last:
                    break
        if members.line() or members.line():
            raise ValueError(f"{archive}: record {number} doesn't end with two empty lines")
        number += 1


def read_chunks(spark: SparkSession, archives: DataFrame, *, with_data: bool = True, rows: int = 256) -> DataFrame:
    """archives: a column ``archive`` of paths. One row for each chunk of each record's payload."""
    schema = spark.createDataFrame([], CHUNKS).schema
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def made(waiting: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*waiting, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in in_parts(batches):
            for archive in column(batch, "archive").to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_stream(path, compression=None) as raw:
                    for chunk in stream_chunks(raw, archive, with_data):
                        waiting.append(chunk)
                        if len(waiting) >= rows:
                            yield made(waiting)
                            waiting = []
        if waiting:
            yield made(waiting)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(read, schema)


def checked_records(chunks: DataFrame) -> DataFrame:
    """One row for each record, from its last chunk. A payload that differs from its record's digest fails the job, with the record's place."""
    said = F.concat(F.lit("payload differs from its digest: record "), F.col("record_no").cast("string"), F.lit(" of "), F.col("archive"))
    digest = F.when(F.coalesce("digest_ok", F.lit(True)), F.col("sha1_so_far")).otherwise(F.raise_error(said).cast("string"))
    return chunks.filter("is_last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def archive_pages(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Writes the archives, reads them back: one row for each record, whose payload fits its digest."""
    spark = pages.sparkSession
    archives = write_archives(spark, revisits(pages, revisit_bytes), fresh_path(spark, "warc"))
    return checked_records(read_chunks(spark, archives, with_data=False))
