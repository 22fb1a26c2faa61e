r"""Line deduplication (operator 8), DataFrame functions only.

Texts are split at \n; a line's key is the line without outer ASCII white space,
A-Z lower-cased. Keys of at least ``min_chars`` code points that are found in at
least two documents lose all their lines but in the document with the smallest
id. Only hashes of keys are shuffled; the texts are shuffled once, to meet the
positions that they lose.

A key is known by two independent hashes and its length (96 bits and more).
Null text is one empty line. A document is a doc_id: rows that repeat an id
count as one document. Lines of rows with a null id are neither counted nor
dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, materialize


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, *, min_chars: int = 10) -> DataFrame:
    """All columns of docs, with ``clean_text``, ``n_lines`` and ``n_dropped``."""
    this = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))]
    exploded = docs.filter(F.col("doc_id").isNotNull()).select(this[0].alias("d"), this[1].alias("t"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = exploded.select("d", "t", "pos", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("key")).filter(F.length("key") >= min_chars)
    hashed = materialize(keyed.select("d", "t", "pos", F.xxhash64("key").alias("h"), F.crc32(F.col("key").cast("binary")).alias("c"), F.length("key").alias("n")), "lines")
    # a document repeats its own lines and copies repeat each other's: one row for each key and task before the shuffle.
    # Written by itself, so that Spark sees its size and can split a line that very many documents share.
    common = materialize(hashed.groupBy("h", "c", "n").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first < last").drop("last"), "common")
    lost = hashed.join(common, ["h", "c", "n"]).filter("d <> first").groupBy("d", "t").agg(F.collect_set("pos").alias("__lost"))
    lost = lost.select(F.col("d").alias("__d"), F.col("t").alias("__t"), "__lost")
    joined = docs.withColumns({"__t0": this[1], "__d0": this[0]}).join(lost, (F.col("__d0") == F.col("__d")) & (F.col("__t0") == F.col("__t")), "left")
    lines = _lines(F.col("text"))
    n = F.size("__lines")
    joined = joined.withColumn("__lines", lines)
    stays = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("__lost")), lambda i: F.get(F.col("__lines"), i))
    clean = F.when(F.col("__lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n"))
    return joined.withColumns({"clean_text": clean, "n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size("__lost"), F.lit(0)).cast("long")}).drop("__lost", "__lines", "__d", "__t", "__d0", "__t0")
