"""Exact duplicates: groups, the projection on one document each, repeated rows of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import trimmed
from ..storage import numbered


def _canonical(docs: DataFrame) -> DataFrame:
    """sha256, canonical path, members: oldest first, then largest, then by path."""
    modified = F.coalesce(F.col("modified_at"), F.lit("9999-12-31T23:59:59+00:00"))
    return docs.groupBy("sha256").agg(F.min_by("path", F.struct(modified, -F.col("size"), "path")).alias("canonical"), F.count("*").alias("members"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """docs: path, sha256, size, modified_at. One row for each member of a group of two or more.

    Group numbers count all contents in the order of their hashes, so they have gaps.
    """
    heads = numbered(_canonical(docs), ["sha256"], "n").filter("members > 1").select("sha256", "canonical", "members", F.concat(F.lit("DUP-"), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(4), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("group_id"))
    return docs.join(heads, "sha256").select("group_id", "sha256", "canonical", "path", (F.col("members") - 1).alias("duplicate_count"))


def canonical_projection(docs: DataFrame) -> DataFrame:
    """All columns of docs with canonical_path, role and aliases (their number)."""
    heads = _canonical(docs)
    own = F.col("path") == F.col("canonical")
    return docs.join(heads, "sha256").withColumns({"canonical_path": F.col("canonical"), "role": F.when(own, "canonical").otherwise("duplicate_alias"), "aliases": F.when(own, F.col("members") - 1).otherwise(0)}).drop("canonical", "members")


def canonical_documents(docs: DataFrame) -> DataFrame:
    """One row for each content, from one pass over the narrow columns and a semi-join."""
    return docs.join(_canonical(docs.select("path", "sha256", "size", "modified_at")).select(F.col("canonical").alias("path")), "path", "left_semi")


def with_aliases(members: DataFrame, docs: DataFrame) -> DataFrame:
    """members (any columns and path) once more for each alias of the path; aliases are marked."""
    heads = _canonical(docs)
    alias = docs.join(heads, "sha256").filter("path <> canonical").select(F.col("canonical").alias("path"), F.col("path").alias("__alias"))
    more = members.join(alias, "path").withColumn("path", F.col("__alias")).drop("__alias").withColumn("duplicate_alias", F.lit(True))
    return members.withColumn("duplicate_alias", F.lit(False)).unionByName(more)


def export_files(docs: DataFrame) -> DataFrame:
    """What a hand-off holds: the first path of each content; the others are listed as left out."""
    first = docs.groupBy("sha256").agg(F.min("path").alias("kept_path"))
    return docs.join(first, "sha256").select("path", "sha256", "kept_path", (F.col("path") != F.col("kept_path")).alias("omitted"), "size")


def duplicate_rows(table: DataFrame) -> DataFrame:
    """One row: rows, and how many repeat an earlier row in all trimmed cells."""
    cells = table.select(*(F.coalesce(trimmed(F.col(f"`{c}`").cast("string")), F.lit("None")).alias(f"c{i}") for i, c in enumerate(table.columns)))
    each = cells.groupBy(*cells.columns).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"))
