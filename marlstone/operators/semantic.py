"""Semantic clusters of documents by average link, at any size, and the tree that they make.

The average similarity of two clusters is the inner product of their mean unit
vectors, so a cluster is one row: its sum and its size. No table of pairs is needed.
Average link never makes a merged cluster nearer to a third one than both parts
were; so all pairs of clusters that are each other's nearest may merge at once, and
a cluster without a neighbour above the threshold will never get one. Rounds of
exact neighbour searches therefore give what merging the closest pair, one after the
other, gives; a rest of at most ``small`` clusters is merged that way by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import human_size
from ..functions.vectors import unit
from ..storage import materialize, numbered
from . import neighbours
from .inventory import first_rows

# Bounds of the threshold, and its part of the median of nearest similarities.
LEAST, MOST, PART = 0.46, 0.72, 0.86
SMALL = 1000


def units(vectors: DataFrame) -> DataFrame:
    """vectors: vec_id, embedding. id, v of unit length; a vector without length is nought. One row of repeated ids."""
    own = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return own.groupBy("id").agg(F.min("v").alias("v")).select("id", unit(F.col("v")).alias("v"))


def nearest_similarities(vectors: DataFrame) -> DataFrame:
    """vec_id, nearest_id, similarity: the nearest other vector of every vector."""
    rows, centres = neighbours.dealt(units(vectors))
    return neighbours.nearest(rows, centres, rows).select(F.col("a").alias("vec_id"), F.col("b").alias("nearest_id"), F.col("score").alias("similarity"))


def link_threshold(near: DataFrame, total: int) -> float:
    """From the upper median of the nearest similarities; a vector alone, or with none above nought, counts as nought."""
    known = materialize(near.select("vec_id", F.greatest("similarity", F.lit(0.0)).alias("s")), "nearest")
    alone = total - known.count()
    place = total // 2 + 1 - alone
    median = numbered(known, ["s", "vec_id"], "n").filter(F.col("n") == place).first()["s"] if place > 0 and total else 0.0
    return max(LEAST, min(MOST, median * PART))


def merge_closest(sums: np.ndarray, sizes: np.ndarray, threshold: float) -> list[list[int]]:
    """Merges the closest pair of clusters, the first among equals, until none reaches the threshold."""
    groups, alive = [[i] for i in range(len(sizes))], np.ones(len(sizes), bool)
    means = sums / sizes[:, None]
    score = np.round(means @ means.T, 12)
    score[np.tril_indices(len(sizes))] = -np.inf
    while alive.sum() > 1:
        i, j = divmod(int(score.argmax()), len(sizes))
        if score[i, j] < threshold:
            break
        sums[i] += sums[j]
        sizes[i] += sizes[j]
        groups[i] += groups[j]
        alive[j] = False
        score[j], score[:, j] = -np.inf, -np.inf
        means[i] = sums[i] / sizes[i]
        row = np.where(alive, np.round(means @ means[i], 12), -np.inf)
        score[i, i + 1 :], score[:i, i] = row[i + 1 :], row[:i]
    return [groups[i] for i in np.flatnonzero(alive)]


def _rest(state: DataFrame, threshold: float) -> DataFrame:
    """id, cluster for at most ``small`` clusters, merged by one task."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids = group["id"].to_numpy()
        found = merge_closest(np.array(group["v"].to_pylist(), float).reshape(len(ids), -1), group["n"].to_numpy().astype(float), threshold)
        return pa.table({"id": pa.array([int(ids[i]) for g in found for i in g], pa.int64()), "cluster": pa.array([int(ids[min(g)]) for g in found for _ in g], pa.int64())})

    return state.groupBy(F.lit(0).alias("rest")).applyInArrow(run, "id long, cluster long")


def average_link(vectors: DataFrame, *, threshold: float | None = None, small: int = SMALL) -> tuple[DataFrame, float]:
    """vec_id, cluster (the smallest id in it); and the threshold."""
    own = materialize(units(vectors), "units")
    if threshold is None:
        rows, centres = neighbours.dealt(own)
        near = neighbours.nearest(rows, centres, rows).select(F.col("a").alias("vec_id"), F.col("score").alias("similarity"))
        threshold = link_threshold(near, rows.count())
    placed = own.select(F.col("id").alias("vec_id"), F.col("id").alias("cluster"))
    state = own.select("id", "v", F.lit(1).cast("long").alias("n"))
    while True:
        state = materialize(state, "clusters")
        rest = state.count() <= small
        if rest:
            moved = materialize(_rest(state, threshold).filter("id <> cluster"), "moved")
        else:
            rows, centres = neighbours.dealt(state.select("id", F.transform("v", lambda e: e / F.col("n")).alias("v")))
            pairs = materialize(neighbours.nearest(rows, centres, rows, floor=threshold - neighbours.SLACK).filter(F.col("score") >= threshold).select("a", "b"), "pairs")
            back = pairs.select(F.col("a").alias("b"), F.col("b").alias("a"))
            moved = materialize(pairs.join(back, ["a", "b"]).filter("a < b").select(F.col("b").alias("id"), F.col("a").alias("cluster")), "moved")
        if moved.isEmpty():
            return placed, threshold
        placed = materialize(placed.join(moved.select(F.col("id").alias("cluster"), F.col("cluster").alias("now")), "cluster", "left").select("vec_id", F.coalesce("now", "cluster").alias("cluster")), "placed")
        if rest:
            return placed, threshold
        # clusters without a neighbour above the threshold are done
        active = state.join(pairs.select(F.col("a").alias("id")), "id", "left_semi")
        added = active.join(moved, "id").select(F.col("cluster").alias("id"), F.col("v").alias("w"), F.col("n").alias("m"))
        left = active.join(moved.select("id"), "id", "left_anti").join(added, "id", "left")
        state = left.select("id", F.when(F.col("w").isNull(), F.col("v")).otherwise(F.zip_with("v", "w", lambda x, y: x + y)).alias("v"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))


def described(vectors: DataFrame, placed: DataFrame) -> DataFrame:
    """vec_id, cluster_id, cluster, size, place (of the three most central), mean_similarity of the cluster's pairs (six digits; null for one).

    Clusters are numbered by falling size, then by their smallest id.
    """
    own = units(vectors).withColumnRenamed("id", "vec_id").join(placed, "vec_id")
    own = materialize(own, "placed-units")
    added = own.select("cluster", F.posexplode("v").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("sum"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, e: t + e)
    sizes = own.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(dot("v", "v")).alias("own"))
    heads = materialize(sizes.join(added, "cluster"), "heads")
    n = F.col("size").cast("double")
    mean = F.when(F.col("size") > 1, F.round((dot("sum", "sum") - F.col("own")) / (n * (n - 1)), 6))
    listed = numbered(heads.select("cluster", "size", mean.alias("mean_similarity")), [-F.col("size"), F.col("cluster")], "n")
    named = listed.select("cluster", "size", "mean_similarity", F.concat(F.lit("SEM-"), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(4), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("cluster_id"))
    central = own.join(heads, "cluster").select("vec_id", "cluster", F.round(F.when(F.col("size") > 1, (dot("v", "sum") - dot("v", "v")) / (n - 1)).otherwise(1.0), 12).alias("central"))
    order = [F.desc("central"), F.col("vec_id")]
    three = first_rows(central, ["cluster"], order, 3).withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy(*order)).cast("long")).select("vec_id", "place")
    return own.select("vec_id", "cluster").join(named, "cluster").join(three, "vec_id", "left").select("vec_id", "cluster_id", "cluster", "size", "place", "mean_similarity")


def semantic_tree(found: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """One group for each cluster and one row for each document in it.

    found: path, cluster, cluster_id, place, mean_similarity. docs: path, size, name.
    names: cluster, name. A group's id comes from its name, its number of files and
    its first path: the list of its paths is never gathered.
    """
    own = docs.select("path", F.col("size").alias("bytes"), F.col("name").alias("file"))
    rows = materialize(found.join(own, "path"), "semantic-files")
    sums = rows.groupBy("cluster", "cluster_id").agg(F.count("*").alias("files"), F.sum("bytes").alias("total_size"), F.min("path").alias("first"), F.max("mean_similarity").alias("mean_similarity"))
    named = sums.join(names.select("cluster", "name"), "cluster")
    groups = materialize(named.withColumn("node_id", F.concat(F.lit("group-"), F.substring(F.sha2(F.concat_ws("|", "name", F.col("files").cast("string"), "first"), 256), 1, 16))), "semantic-groups")
    none = lambda kind: F.lit(None).cast(kind)
    heads = groups.select("node_id", F.lit("root").alias("parent_id"), F.lit("group").alias("kind"), "name", none("string").alias("path"), "files", "total_size", "cluster_id", "mean_similarity", none("long").alias("place"))
    leaves = rows.join(groups.select("cluster", F.col("node_id").alias("parent_id")), "cluster").select(
        F.concat(F.lit("file-"), F.substring(F.sha2("path", 256), 1, 16)).alias("node_id"), "parent_id", F.lit("file").alias("kind"), F.col("file").alias("name"), "path", F.lit(1).cast("long").alias("files"), F.col("bytes").alias("total_size"), "cluster_id", none("double").alias("mean_similarity"), "place"
    )
    return heads.union(leaves).withColumn("total_size_human", human_size(F.col("total_size")))
