"""Clusters of vectors: neighbours, k-means, average link, sign buckets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine, sign_bits, unit
from ..storage import materialize
from . import semantic
from .inventory import first_rows
from .neighbours import best_partners, dealt
from .semantic import SMALL


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k nearest rows by cosine for each query, itself left out."""
    rows, centres = dealt(vectors.select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("v")))
    asked = materialize(queries.select(F.col("query_id").cast("long").alias("id"), unit(F.col("embedding")).alias("v")), "asked")
    found = best_partners(rows, centres, asked, k=k)
    near = found.select(F.col("a").alias("query_id"), F.col("b").alias("vec_id"), F.round("score", 6).alias("similarity"))
    order = [F.desc("similarity"), F.col("vec_id")]
    return near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def sign_buckets(vectors: DataFrame, total: int) -> DataFrame:
    """vec_id, bucket: the first 16 signs, modulo the number of clusters that k-means would have."""
    return vectors.select("vec_id", (sign_bits(F.col("embedding")) % F.lit(cluster_count(total))).alias("bucket"))


def cluster_count(total: int) -> int:
    return max(8, min(96, round(math.sqrt(total))))


def average_link(vectors: DataFrame, *, small: int = SMALL) -> DataFrame:
    """vec_id, cluster_id, cluster (the smallest id in it), size, place among the three most central, mean similarity, threshold; for any number of vectors."""
    placed, threshold = semantic.average_link(vectors, small=small)
    return semantic.described(vectors, placed).withColumn("threshold", F.round(F.lit(threshold), 6))


def clusters(vectors: DataFrame, *, seed: int = 42) -> DataFrame:
    """vec_id, cluster (the smallest id in it), size, place among the three next to the centre, mean similarity to it.

    Distributed k-means with round(sqrt(n)) clusters, 8 to 96, at every size.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = own.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=cluster_count(own.count()), seed=seed, maxIter=40).fit(points)
    centres = vectors.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    placed = model.transform(points).join(F.broadcast(centres), "prediction").withColumn("similarity", cosine(vector_to_array("features"), F.col("centre")))
    heads = placed.groupBy("prediction").agg(F.min("vec_id").alias("cluster"), F.count("*").alias("size"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))
    best = first_rows(placed.select("prediction", "vec_id", "similarity"), ["prediction"], [F.desc("similarity"), F.col("vec_id")], 3)
    ranked = best.withColumn("place", F.row_number().over(W.partitionBy("prediction").orderBy(F.desc("similarity"), "vec_id")).cast("long")).select("vec_id", "place")
    return placed.select("vec_id", "prediction").join(F.broadcast(heads), "prediction").join(F.broadcast(ranked), "vec_id", "left").select("vec_id", "cluster", "size", "place", "mean_similarity")


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys (cache_key, model) that have no vector yet."""
    return wanted.select("cache_key", "model").distinct().join(cache.select("cache_key", "model"), ["cache_key", "model"], "left_anti")
