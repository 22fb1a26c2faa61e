"""Members of archives as rows, with a ledger: each member is extracted, skipped for a reason, or failed."""

from __future__ import annotations

import bz2
import gzip
import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVES = [".zip", ".tar", ".tgz", ".gz", ".bz2"]
MAX_MEMBERS, MAX_MEMBER, MAX_TOTAL, MAX_DEPTH = 2000, 64 << 20, 512 << 20, 3
SCHEMA = "path string, member string, size long, status string, reason string, content binary"
ARROW = pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("status", pa.string()), ("reason", pa.string()), ("content", pa.binary())])
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def unsafe(name: str) -> bool:
    """Names that would leave the archive's own folder."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    return clean.startswith(("/", "../")) or clean == ".." or ":" in clean.split("/")[0]


def _opened(path: str, raw: bytes) -> Iterator[tuple[str, int, bool, object]]:
    """name, size, whether it is a link, and a function that reads at most n bytes."""
    low = path.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, m.file_size, (m.external_attr >> 28) == 0xA, lambda n, m=m: z.open(m).read(n)
    elif low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2")):
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t:
                if not m.isdir():
                    yield m.name, m.size, not m.isreg(), lambda n, m=m: t.extractfile(m).read(n)
    else:
        opener = gzip.open if low.endswith(".gz") else bz2.open
        name = posixpath.basename(path).rsplit(".", 1)[0]
        yield name if "." in name else f"{name}.txt", -1, False, lambda n: opener(io.BytesIO(raw)).read(n)


class Budget:
    """What one file may unpack in all, its inner archives included."""

    def __init__(self, max_members: int, max_member: int, max_total: int, max_depth: int):
        self.members, self.member, self.left, self.depth = max_members, max_member, max_total, max_depth


def walked(path: str, raw: bytes, budget: Budget, above: str = "", depth: int = 1) -> Iterator[tuple]:
    """A row for each member, those of inner archives behind the archive's own row.

    A member's name has the inner archives on its way before it, parted by ``::``. An
    archive that is opened has the status "opened"; each level holds one member's
    bytes, which are let go before the next is read.
    """
    try:
        for name, size, link, read in _opened(path, raw):
            full = above + name
            inner = name.lower().endswith(tuple(ARCHIVES))
            reason = "unsafe name" if unsafe(name) else "link" if link else "too many members" if not budget.members else "too deep" if inner and depth >= budget.depth else "too large" if size > budget.member else "total too large" if max(size, 0) > budget.left else None
            if reason:
                yield full, size, "skipped", reason, None
                continue
            budget.members -= 1
            allowed = min(budget.member, budget.left)
            try:
                data = read(allowed + 1)
            except Exception as x:  # one bad member must not hide the others
                yield full, size, "failed", type(x).__name__, None
                continue
            if len(data) > allowed:  # it holds more than it said
                yield full, size, "skipped", "too large" if len(data) > budget.member else "total too large", None
                continue
            budget.left -= len(data)
            if inner:
                yield full, len(data), "opened", None, None
                yield from walked(name, data, budget, f"{full}::", depth + 1)
            else:
                yield full, len(data), "extracted", None, data
            del data
    except Exception as x:  # not an archive at all
        yield above.removesuffix("::"), 0, "failed", type(x).__name__, None


def members(files: DataFrame, *, max_members: int = MAX_MEMBERS, max_member: int = MAX_MEMBER, max_total: int = MAX_TOTAL, max_depth: int = MAX_DEPTH) -> DataFrame:
    """files: path, content. One row for each member of each archive and of the archives in it, down to ``max_depth`` levels.

    Members are read in memory and never written out. All levels of a file share its
    bounds on members and bytes. Rows leave a task in batches of a bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

        for batch in batches:
            for path, raw in zip(batch.column(0), batch.column(1), strict=True):
                for row in walked(path.as_py(), raw.as_py() or b"", Budget(max_members, max_member, max_total, max_depth)):
                    rows.append((path.as_py(), *row))
                    held += len(row[4] or b"")
                    if len(rows) == BATCH_ROWS or held > BATCH_BYTES:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return files.select("path", "content").mapInArrow(run, SCHEMA)


class ArchiveMembers:
    """The members of one archive, for SQL: ``SELECT path, m.* FROM files, LATERAL archive_members(path, content) m``."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        if content is not None:
            yield from walked(path, bytes(content), Budget(MAX_MEMBERS, MAX_MEMBER, MAX_TOTAL, MAX_DEPTH))


def register(spark: SparkSession) -> None:
    """Makes the table function ``archive_members`` known to the session's SQL."""
    spark.udtf.register("archive_members", F.udtf(ArchiveMembers, returnType="member string, size long, status string, reason string, content binary"))


def ledger(found: DataFrame) -> DataFrame:
    """Totals of each archive, the members of inner ones included; one skipped or failed member makes its coverage partial."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = found.groupBy("path").agg(F.count("*").alias("total_members"), n("extracted", "opened").alias("parsed_members"), n("opened").alias("inner_archives"), n("skipped").alias("skipped_members"), n("failed").alias("failed_members"))
    return out.withColumn("complete", F.col("parsed_members") == F.col("total_members"))
