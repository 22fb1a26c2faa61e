"""Inventories of files: names, types, folders, policy, samples, coverage."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import human_size

# What a scan leaves out, and which types are dense text.
IGNORED_FOLDERS = [".git", ".venv", ".venv_py37_unused", "__pycache__", "node_modules", ".idea", ".vscode", "vendor_packages", "work"]
IGNORED_FILES = [".env", "agent.db", "agent.db-shm", "agent.db-wal"]
SECRET_EXTENSIONS = [".key", ".pem", ".p12", ".pfx", ".keystore"]
DENSE_EXTENSIONS = [".csv", ".tsv", ".txt", ".json", ".jsonl", ".md", ".markdown"]
DENSE_BYTES = 5 * 1024 * 1024


def with_names(files: DataFrame) -> DataFrame:
    """files: path (with /), size. Adds name, extension, parent_path and depth."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    return files.withColumns({"name": name, "extension": extension, "parent_path": F.when(parent == "", ".").otherwise(parent), "depth": F.size(F.split("path", "/")).cast("long") - 1})


def kept(files: DataFrame) -> DataFrame:
    """Leaves out version-control and tool folders, databases, lock files and keys."""
    folders = F.transform(F.split("parent_path", "/"), lambda x: F.lower(x))
    bad = F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_FOLDERS))) | F.lower("name").isin(IGNORED_FILES) | F.startswith("name", F.lit("~$")) | F.col("extension").isin(SECRET_EXTENSIONS)
    return files.filter(~bad)


def natural_key(c: Column) -> Column:
    """Sorts digit runs by value: each is led by its length."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 4, "0"), bare(x))).otherwise(x)), "")


def in_scope(path: Column, scope: str) -> Column:
    """The folder itself, what is below it, and members of an archive of that name."""
    if scope in ("", "."):
        return F.lit(True)
    return (path == scope) | path.startswith(scope.rstrip("/") + "/") | path.startswith(scope + "::")


def type_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("extension").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("size").alias("least_bytes"), F.max("size").alias("most_bytes"))


def _ancestors(parent: Column) -> Column:
    parts = F.split(parent, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(parent == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), below))


def directory_rollup(files: DataFrame) -> DataFrame:
    """Files and bytes below each folder and directly in it. A file counts once for each of its ancestors."""
    by_folder = files.groupBy("parent_path", "extension").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    spread = by_folder.withColumn("directory", F.explode(_ancestors(F.col("parent_path"))))
    direct = F.when(F.col("parent_path") == F.col("directory"), F.col("n")).otherwise(0)
    by_type = spread.groupBy("directory", "extension").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(direct).alias("d"))
    # one struct for each type, and types are few
    types = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("extension").alias("e"))))
    return by_type.groupBy("directory").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.sum("d").alias("direct_files"), F.array_join(F.transform(types, lambda x: F.concat(x.e, F.lit(":"), (-x.o).cast("string"))), "|").alias("types"))


def policy(files: DataFrame, *, threshold_bytes: int = 1 << 30, threshold_files: int = 3000) -> dict[str, Any]:
    """Whether the inventory counts as a large package."""
    r = files.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    large = (r["b"] or 0) >= threshold_bytes or r["n"] >= threshold_files
    return {"mode": "large_package" if large else "standard", "enabled": large, "inventory_files": r["n"], "inventory_bytes": r["b"] or 0}


def representative_sample(files: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` paths: small dense text first, then the first and last path of each type, then a fill."""
    dense = F.col("extension").isin(DENSE_EXTENSIONS) & (F.col("size") < DENSE_BYTES)
    files = files.select("path", "size", "extension", dense.alias("dense"))
    quota = max(1, int(limit * 0.35))
    first = files.filter("dense").orderBy("size", "path").limit(quota).select("path", F.lit(0).alias("stage"), F.struct(F.col("size").alias("a"), F.col("path").alias("b"), F.lit(0).alias("c")).alias("place"))
    ends = files.groupBy("extension").agg(F.min("path").alias("lo"), F.max("path").alias("hi"), (-F.count("*")).alias("a"))
    second = ends.select(F.explode(F.array(F.struct(F.col("lo").alias("path"), F.lit(0).alias("c")), F.struct(F.col("hi").alias("path"), F.lit(1).alias("c")))).alias("x"), "a", "extension").select("x.path", F.lit(1).alias("stage"), F.struct("a", F.col("extension").alias("b"), F.col("x.c").alias("c")).alias("place"))
    fill = files.orderBy((~F.col("dense")).cast("int"), "path").limit(2 * limit + quota).select("path", F.lit(2).alias("stage"), F.struct((~F.col("dense")).cast("long").alias("a"), F.col("path").alias("b"), F.lit(0).alias("c")).alias("place"))
    each = first.unionByName(second).unionByName(fill).groupBy("path").agg(F.min(F.struct("stage", "place")).alias("x"))
    return each.orderBy("x").limit(limit).select("path", F.col("x.stage").alias("stage"))


def even_sample(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``size`` rows at even distances in the order given."""
    from ..storage import numbered

    total = rows.count()
    if total <= size:
        return rows
    places = sorted({round(i * (total - 1) / max(1, size - 1)) + 1 for i in range(size)})
    return numbered(rows, [order], "__n").filter(F.col("__n").isin(places)).drop("__n")


def coverage(files: DataFrame, states: DataFrame, scopes: DataFrame) -> DataFrame:
    """Coverage of each scope.

    files: path, size. states: path, parsed, failed, complete, sampled (booleans,
    one row for each path). scopes: scope, path; a scope without paths of the
    inventory is left out here and counts as empty, never as everything. Paths
    without a state are pending.
    """
    own = scopes.join(files.select("path", "size"), "path").join(states, "path", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    parsed, failed = yes("parsed"), yes("failed")
    out = own.groupBy("scope").agg(
        F.count("*").alias("inventory_files"),
        F.count_if(parsed).alias("parsed_files"),
        F.count_if(failed).alias("failed_files"),
        F.count_if(~parsed & ~failed).alias("pending_files"),
        F.count_if(parsed & yes("complete")).alias("complete_text_files"),
        F.count_if(parsed & ~yes("complete")).alias("partial_text_files"),
        F.count_if(parsed & yes("sampled")).alias("sampled_files"),
        F.sum("size").alias("inventory_bytes"),
        F.sum(F.when(parsed, F.col("size")).otherwise(0)).alias("parsed_bytes"),
    )
    whole = (F.col("pending_files") == 0) & (F.col("failed_files") == 0) & (F.col("partial_text_files") == 0)
    some = F.col("parsed_files") > 0
    return out.withColumns({
        "parsed_file_ratio": F.round(F.col("parsed_files") / F.col("inventory_files"), 6),
        "parsed_byte_ratio": F.round(F.col("parsed_bytes") / F.greatest("inventory_bytes", F.lit(1)), 6),
        "complete_analysis": whole,
        "coverage_level": F.when(whole, "full_text_analysis").when(some, "representative_overview").otherwise("inventory_complete"),
        "inventory_size_human": human_size(F.col("inventory_bytes")),
    })


def folder_scopes(files: DataFrame) -> DataFrame:
    """scope, path for each folder that a file is below."""
    return files.select(F.explode(_ancestors(F.col("parent_path"))).alias("scope"), "path")


def reuse(files: DataFrame, states: DataFrame) -> DataFrame:
    """Which files need no new work. files: path, size, modified_at; states: path, status, fingerprint."""
    fingerprint = F.concat_ws("|", "path", F.col("size").cast("string"), F.coalesce("modified_at", F.lit("")))
    own = files.withColumn("now", fingerprint).join(states.select("path", F.col("fingerprint").alias("was"), "status"), "path", "left")
    same = F.col("status").isin("completed", "overview") & (F.col("now") == F.col("was"))
    return own.select("path", F.when(same, "reuse").otherwise("parse").alias("action"), F.when(F.col("status").isNull(), "new").when(~F.col("status").isin("completed", "overview"), "unfinished").when(F.col("now") != F.col("was"), "changed").otherwise("unchanged").alias("reason"))


def shared_topic_limit(documents: int) -> int:
    return 6 if documents <= 10 else 8 if documents <= 50 else 12


def most_common_frequency(documents: int) -> int:
    return max(2, math.ceil(documents * 0.85))


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark drops rows beyond n before the shuffle."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def listing(files: DataFrame) -> DataFrame:
    """parent_path, name, is_folder, place: what each folder holds, folders first, then by name with numbers by value."""
    from ..storage import materialize, numbered

    below = files.select(F.explode(F.filter(_ancestors(F.col("parent_path")), lambda x: x != ".")).alias("folder")).distinct()
    parent = F.regexp_replace("folder", r"/?[^/]*$", "")
    folders = below.select(F.when(parent == "", ".").otherwise(parent).alias("parent_path"), F.element_at(F.split("folder", "/"), -1).alias("name"), F.lit(True).alias("is_folder"))
    both = folders.unionByName(files.select("parent_path", "name", F.lit(False).alias("is_folder"))).withColumn("__key", natural_key(F.col("name")))
    dealt = materialize(numbered(both, ["parent_path", ~F.col("is_folder"), "__key", "name"], "__n"), "listing")
    first = dealt.groupBy("parent_path").agg((F.min("__n") - 1).alias("__before"))
    return dealt.join(first, "parent_path").select("parent_path", "name", "is_folder", (F.col("__n") - F.col("__before")).alias("place"))


def time_range(files: DataFrame) -> DataFrame:
    """One row: the first and last day on which a file was changed (null if none is known), and how many files say so."""
    day = F.substring(F.nullif("modified_at", F.lit("")), 1, 10)
    return files.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(day).alias("dated_files"))
