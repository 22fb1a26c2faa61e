"""Profiles of many tables in files at once: one row for each column of each file, and one for each file.

found: what ``sources.bounded`` or ``sources.structured`` gives, the rows and the
notes of any number of files. A file's reader has bounded its rows, so the cells of
one column of one file may meet in one task; the files themselves are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import ENTITY, SENSITIVE, date, kind, missing, named_like, number, trimmed
from ..sources.structured import record_ledger
from ..storage import materialize
from .profile import listed_columns, quality_score, value_level

KEY = ["path", "column"]


def file_cells(found: DataFrame) -> DataFrame:
    """path, column, position, value (trimmed text or null), n, first_row, kind, number, date.

    A record without a key misses that cell. Columns stand in the order in which
    the file's records first have them.
    """
    rows = found.filter("row_no is not null")
    each = rows.select("path", "row_no", F.posexplode("record").alias("place", "column", "value"))
    counted = each.groupBy(*KEY, trimmed(F.col("value")).alias("value")).agg(F.count("*").alias("n"), F.min(F.struct("row_no", "place")).alias("first"))
    counted = materialize(counted, "file-cells")
    own = counted.groupBy(*KEY).agg(F.sum("n").alias("there"), F.min("first").alias("first"))
    placed = own.withColumn("position", F.row_number().over(W.partitionBy("path").orderBy("first")).cast("long") - 1)
    placed = placed.join(rows.groupBy("path").agg(F.count("*").alias("all")), "path")
    absent = placed.filter("there < all").select(*KEY, "position", F.lit(None).cast("string").alias("value"), (F.col("all") - F.col("there")).alias("n"), F.when(F.col("first.row_no") > 1, F.lit(1)).otherwise(F.col("all")).cast("long").alias("first_row"))
    present = counted.join(placed.select(*KEY, "position"), KEY).select(*KEY, "position", "value", "n", F.col("first.row_no").alias("first_row"))
    v = F.col("value")
    return present.union(absent).select(*KEY, "position", "value", "n", "first_row", kind(v).alias("kind"), number(v).alias("number"), F.when(~missing(v), date(v)).alias("date"))


def file_columns(cells: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row for each column of each file. ledger: path, rows."""
    cells = materialize(cells, "cells-of-files")
    kinds = cells.groupBy(*KEY, "kind").agg(F.sum("n").alias("k"), F.min("first_row").alias("f")).groupBy(*KEY).agg(F.min_by("kind", F.struct(-F.col("k"), "f", "kind")).alias("inferred_type"))
    known, n, x = ~missing(F.col("value")), F.col("n"), F.col("number")
    base = cells.groupBy(*KEY, "position").agg(
        F.sum(F.when(known, 0).otherwise(n)).alias("missing_count"),
        F.count_if(known).alias("unique_count"),
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(f"{k}_cells") for k in ("number", "datetime", "text")),
        F.min("number").alias("min"), F.max("number").alias("max"), F.sum(x * n).alias("sum"),
        F.min("date").alias("min_datetime"), F.max("date").alias("max_datetime"),
    )
    numbers = cells.filter("number is not null").groupBy(*KEY, "number").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*KEY)
    upto = numbers.withColumns({"upto": F.sum("n").over(by.orderBy("number")), "count": F.sum("n").over(by)})
    at = lambda share: F.max(F.when((F.col("upto") - n <= F.floor(F.col("count") * share)) & (F.floor(F.col("count") * share) < F.col("upto")), x)).over(by)
    ranked = upto.withColumns({"q1": at(0.25), "median": at(0.5), "q3": at(0.75)})
    spread = (F.col("q3") - F.col("q1")) * 1.5
    outside = (x < F.col("q1") - spread) | (x > F.col("q3") + spread)
    order = ranked.groupBy(*KEY).agg(F.first("count").alias("count"), F.first("median").alias("median"), F.sum(F.when(outside, n).otherwise(0)).alias("outliers"))
    met = base.join(kinds, KEY).join(order, KEY, "left").join(ledger.select("path", "rows"), "path")
    return met.select(
        *KEY, "position", "inferred_type", "missing_count", F.round(F.col("missing_count") / F.greatest(F.col("rows"), F.lit(1)), 6).alias("missing_ratio"),
        "unique_count", "number_cells", "datetime_cells", "text_cells", "min", "max", F.round("sum", 6).alias("sum"), F.coalesce("count", F.lit(0)).alias("count"),
        F.round(F.col("sum") / F.nullif("count", F.lit(0)), 6).alias("mean"), "median", F.when(F.col("count") >= 4, F.col("outliers")).alias("outlier_count"),
        "min_datetime", "max_datetime",
        F.array_join(named_like(F.col("column"), SENSITIVE), "|").alias("sensitive_categories"),
        F.array_join(named_like(F.col("column"), ENTITY), "|").alias("entity_categories"),
    )


def repeated_records(found: DataFrame) -> DataFrame:
    """path, duplicate_row_count: records that repeat an earlier one of the file in all trimmed cells; a missing cell is an empty one."""
    cells = F.array_sort(F.filter(F.transform(F.map_entries("record"), lambda e: F.struct(e["key"].alias("key"), trimmed(e["value"]).alias("value"))), lambda e: e["value"].isNotNull()))
    told = F.to_json(cells)
    each = found.filter("row_no is not null").groupBy("path", F.xxhash64(told).alias("h"), F.crc32(told.cast("binary")).alias("c")).agg(F.count("*").alias("n"))
    return each.groupBy("path").agg(F.sum(F.col("n") - 1).alias("duplicate_row_count"))


def file_profiles(columns: DataFrame, ledger: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row for each file: status, coverage, quality and the names of its columns by kind.

    columns: file_columns; ledger: structured.record_ledger. A file without rows has
    no columns and a score of nought. A file that a bound has cut, or that had
    errors, is not complete: its profile covers what was read.
    """
    rows = F.col("row_count")
    named = columns.join(ledger.select("path", F.col("rows").alias("row_count")), "path").groupBy("path").agg(
        F.count("*").alias("column_count"),
        F.sum("missing_count").alias("missing"),
        F.count_if(F.col("unique_count") >= F.greatest(F.lit(1.0), rows * 0.9)).alias("unique_columns"),
        listed_columns(F.col("missing_count") > 0).alias("missing_columns"),
        listed_columns(F.col("inferred_type") == "number").alias("numeric_columns"),
        listed_columns(F.col("inferred_type") == "datetime").alias("temporal_columns"),
        listed_columns(F.col("sensitive_categories") != "").alias("sensitive_columns"),
    )
    met = ledger.withColumnRenamed("rows", "row_count").join(named, "path", "left").join(repeated, "path", "left")
    full = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("column_count", "missing", "unique_columns", "duplicate_row_count")} | {c: F.coalesce(c, F.lit("")) for c in ("missing_columns", "numeric_columns", "temporal_columns", "sensitive_columns")})
    penalty = F.least(F.lit(0.25), F.col("duplicate_row_count") / F.greatest(rows, F.lit(1)))
    score = quality_score(F.col("missing"), F.col("unique_columns"), F.col("column_count"), rows, penalty)
    scored = full.withColumn("quality_score", score)
    return scored.select(
        "path", "status", "encoding", "row_count", "column_count", "duplicate_row_count", "quality_score", F.when(F.col("status") == "failed", "needs_work").otherwise(value_level(F.col("quality_score"), rows)).alias("value_level"),
        (F.col("status") == "completed").alias("complete"), (F.size("reasons") > 0).alias("truncated"), F.array_join("reasons", "|").alias("reasons"), "parse_errors", "replaced", "read_bytes", "source_bytes", "failure",
        "missing_columns", "numeric_columns", "temporal_columns", "sensitive_columns",
    )


def profile_files(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of the columns and of the files, from one reading."""
    found = materialize(found, "records")
    ledger = materialize(record_ledger(found), "ledger")
    columns = materialize(file_columns(file_cells(found), ledger), "file-columns")
    return columns, file_profiles(columns, ledger, repeated_records(found))
