"""Tables that results are kept in, and hand-off folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import cache_misses

# Characters that XML can't hold.
XML_BAD = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}\x{fdd0}-\x{fdef}\x{fffe}\x{ffff}]"


def xml_safe(c: Column) -> Column:
    return F.regexp_replace(c, XML_BAD, "")


def safe_name(c: Column, length: int = 80) -> Column:
    """A file name: other characters than letters, digits, Chinese, dot and dash become _."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._\x{4e00}-\x{9fff}-]+", "_")
    return F.substring(F.coalesce(F.nullif(F.regexp_replace(clean, "^[_.]+|[_.]+$", ""), F.lit("")), F.lit("export")), 1, length)


def replace_scan(rows: DataFrame, path: str, key: str = "scan_id") -> None:
    """Replaces the partitions of the scans in the rows, leaving all others; one commit."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def index_rows(units: DataFrame, scan_id: str) -> DataFrame:
    """Evidence units with the key that an index knows them by."""
    key = F.sha2(F.concat_ws("|", "path", "evidence_id", "content_sha256", "text"), 256)
    return units.withColumns({"scan_id": F.lit(scan_id), "index_key": key})


def add_embeddings(new: DataFrame, path: str) -> None:
    """Appends vectors (cache_key, model, embedding) whose key isn't there yet."""
    spark = new.sparkSession
    try:
        known = spark.read.parquet(path)
    except Exception as x:
        if "PATH_NOT_FOUND" not in str(x):
            raise
        known = new.limit(0)
    first = new.groupBy("cache_key", "model").agg(F.min_by("embedding", F.hash("embedding")).alias("embedding"))
    first.join(cache_misses(first, known), ["cache_key", "model"], "left_semi").write.mode("append").parquet(path)


def recent_results(results: DataFrame, now: Column, days: int = 7, most: int = 1000) -> DataFrame:
    """Search results that are kept: of the last days, and of those the newest."""
    return results.filter(F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")).orderBy(F.desc("created_at")).limit(most)


def project_document(c: Column, most: int, mark: str = "\n...\n") -> Column:
    """A text's head (72 %) and tail, with a mark between, where it is longer than ``most``."""
    head = int(most * 0.72)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(mark), F.right(c, F.lit(most - head))))


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """One folder of JSON lines for each table."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
