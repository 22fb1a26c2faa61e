"""Folders listed by tasks, level by level, with a row for every branch that is refused.

The driver knows no file: each level's folders are a table, tasks list them, and what
they find is written. A level is as many folders as the tree is wide there, so a tree
with one very wide or very deep branch is listed like any other. Links are never
followed, so no loop can arise; folders below ``max_depth``, links, folders that a
scan leaves out and ones that can't be read stay in the ledger with the reason.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import IGNORED_FOLDERS
from ..storage import materialize

FOUND = "path string, kind string, depth long, size long, modified_at string, reason string"
ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("depth", pa.int64()), ("size", pa.int64()), ("modified_at", pa.string()), ("reason", pa.string())])
BATCH = 10_000


def _entries(store: fs.FileSystem, place: str) -> Iterator[tuple[str, str, int | None, datetime | None]]:
    """Name, kind (file, folder or link), size and time of what a folder holds."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(place) as found:
            for e in found:
                if e.is_symlink():
                    yield e.name, "link", None, None
                elif e.is_dir(follow_symlinks=False):
                    yield e.name, "folder", None, None
                elif e.is_file(follow_symlinks=False):
                    s = e.stat(follow_symlinks=False)
                    yield e.name, "file", s.st_size, datetime.fromtimestamp(s.st_mtime, UTC)
        return
    for f in store.get_file_info(fs.FileSelector(place)):
        kind = {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(f.type)
        if kind:
            yield f.base_name, kind, f.size if kind == "file" else None, f.mtime


def _listed(store: fs.FileSystem, base: str, folder: str, depth: int, max_depth: int) -> Iterator[tuple]:
    """Rows of one folder (path below the base; empty for the base itself)."""
    try:
        for name, kind, size, time in _entries(store, f"{base}/{folder}" if folder else base):
            path = f"{folder}/{name}" if folder else name
            reason = None
            if kind == "link":
                reason = "link"
            elif kind == "folder":
                reason = "left out" if name.lower() in IGNORED_FOLDERS else "too deep" if depth + 1 > max_depth else None
            yield path, kind, depth, size, time.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S+00:00") if time else None, reason
    except (OSError, pa.ArrowException) as x:
        yield folder or ".", "folder", depth - 1, None, None, f"unreadable: {type(x).__name__}"


def walk(spark: SparkSession, root: str, max_depth: int = 32) -> DataFrame:
    """path (below the root), kind (file, folder, link), depth (of its folder; 0 in the root), size, modified_at, reason (null where it is listed)."""
    uri = str(root) if "://" in str(root) or str(root).startswith("file:") else f"file://{quote(os.path.abspath(root))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            for folder, depth in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in _listed(store, base.rstrip("/"), folder, depth, max_depth):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield out()
                        rows = []
        if rows:
            yield out()

    level = spark.createDataFrame([("", 0)], "path string, depth long")
    found, many = None, 2 * spark.sparkContext.defaultParallelism
    while True:
        one = materialize(level.repartition(many, "path").mapInArrow(run, FOUND), "listing")
        found = one if found is None else found.union(one)
        level = one.filter("kind = 'folder' and reason is null").select("path", (F.col("depth") + 1).alias("depth"))
        if level.isEmpty():
            return found


def ledger(found: DataFrame) -> DataFrame:
    """reason, kind, entries: how much was listed (null reason) and how much refused, and why; a scan is complete if only folders that it leaves out were refused."""
    return found.groupBy("reason", "kind").agg(F.count("*").alias("entries"), F.max("depth").alias("deepest"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
