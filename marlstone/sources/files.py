"""Files as rows: inventory of a folder, their bytes, their text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.inventory import kept, with_names

# Types that are read as text.
TEXT_EXTENSIONS = [".txt", ".md", ".markdown", ".csv", ".tsv", ".json", ".jsonl", ".xml", ".html", ".htm", ".log", ".ini", ".cfg", ".yaml", ".yml", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".sql"]
ENCODINGS = ["utf-8-sig", "utf-8", "gb18030", "utf-16"]


def _listed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def _relative(path: Column, root: str) -> Column:
    base = root.rstrip("/").split("://")[-1]
    base = "/" + base.removeprefix("file:").lstrip("/") + "/"
    return F.url_decode(F.replace(F.substring_index(path, base, -1), F.lit("+"), F.lit("%2B")))


def scan(spark: SparkSession, root: str, max_depth: int = 32) -> DataFrame:
    """Inventory of all files below the folder: path (relative), size, modified_at and names. No file is opened.

    ``listing.walk`` has the ledger of what was refused on the way.
    """
    from .listing import walk

    return kept(with_names(walk(spark, root, max_depth).filter("kind = 'file' and reason is null").select("path", "size", "modified_at")))


def resolve_under(requested: Column, root: str) -> Column:
    """The path without dots, below the root; null where it leaves the root. Relative paths start at the root."""
    base = "/" + "/".join(x for x in root.split("/") if x not in ("", "."))
    given = F.replace(requested, F.lit("\\"), F.lit("/"))
    parts = F.split(F.when(given.startswith("/"), given).otherwise(F.concat(F.lit(base + "/"), given)), "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x.isin("", "."), done).otherwise(F.concat(done, F.array(x))))
    path = F.concat(F.lit("/"), F.array_join(walked, "/"))
    return F.when((path == base) | path.startswith(base.rstrip("/") + "/"), path)


def contents(spark: SparkSession, root: str, max_bytes: int = 256 << 20) -> DataFrame:
    """path, size, modified_at, extension, content; larger files keep their row without content, so that they can be reported."""
    found = _listed(spark, root).select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("modified_at"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    return kept(with_names(found))


@F.pandas_udf(StringType())
def _decode_other(data: pd.Series) -> pd.Series:
    return data.map(decode)


def decode(raw: bytes | None) -> str | None:
    """The first encoding that fits; else UTF-8 with replacement marks."""
    if raw is None:
        return None
    for name in ENCODINGS:
        try:
            return bytes(raw).decode(name)
        except UnicodeError:
            continue
    return bytes(raw).decode("utf-8", "replace")


def text_of(content: Column) -> Column:
    """Text of bytes. Valid UTF-8 never leaves the JVM; only other bytes go through Python."""
    valid = F.try_validate_utf8(content.cast("string"))
    return F.when(valid.isNotNull(), F.regexp_replace(valid, "^﻿", "")).otherwise(_decode_other(F.when(valid.isNull(), content)))


def changed_while_read(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose size or time differ between two inventories; their parse can't be trusted."""
    same = (before["size"] == after["size"]) & before["modified_at"].eqNullSafe(after["modified_at"])
    return before.join(after, before["path"] == after["path"], "left").filter(~F.coalesce(same, F.lit(False))).select(before["path"])


def parse(files: DataFrame) -> DataFrame:
    """files: path, extension, content. Unified documents: path, sha256, parser, status, text, complete, warning.

    A file that can't be read has a status and a warning; it never fails the job.
    """
    from .archives import ARCHIVES, members
    from .office import OFFICE, office_text

    hashed = files.withColumn("sha256", F.sha2("content", 256))
    text = hashed.filter(F.col("extension").isin(TEXT_EXTENSIONS) & F.col("content").isNotNull()).select("path", "sha256", F.lit("text").alias("parser"), F.lit("completed").alias("status"), text_of(F.col("content")).alias("text"), F.lit(True).alias("complete"), F.lit(None).cast("string").alias("warning"))
    office = office_text(hashed.filter(F.col("extension").isin(OFFICE) & F.col("content").isNotNull()))
    packed = members(hashed.filter(F.col("extension").isin(ARCHIVES) & F.col("content").isNotNull()))
    inside = packed.filter("status = 'extracted'").select(F.concat("path", F.lit("::"), "member").alias("path"), F.sha2("content", 256).alias("sha256"), F.lit("archive").alias("parser"), F.lit("completed").alias("status"), text_of(F.col("content")).alias("text"), F.lit(True).alias("complete"), F.lit(None).cast("string").alias("warning"))
    known = F.col("extension").isin(TEXT_EXTENSIONS + OFFICE + ARCHIVES)
    rest = hashed.filter(~known | F.col("content").isNull()).select("path", "sha256", F.lit("none").alias("parser"), F.lit("skipped").alias("status"), F.lit("").alias("text"), F.lit(False).alias("complete"), F.when(F.col("content").isNull(), "too large").otherwise("type not supported").alias("warning"))
    return text.unionByName(office).unionByName(inside).unionByName(rest)


def by_batch(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """Rows of pandas batches, one at a time."""
    for frame in frames:
        yield from frame.to_dict("records")
