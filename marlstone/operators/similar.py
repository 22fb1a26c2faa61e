"""Similar documents by 64-bit SimHash: fingerprints, links, groups.

Documents with one fingerprint are one class and only classes are compared. A link
needs a Hamming distance of at most 8 and a size ratio of at least .55, or else
that most words of the smaller text stand in the larger one and a distance of at
most 14. All such pairs are found:

* of ten blocks of a fingerprint at most eight differ within a distance of 8, so
  two are alike: classes meet by pairs of blocks, 45 keys of 12 to 14 bits each;
* a text with four fifths of its words in another has one of its rarest fifth
  there: classes meet by these words, which few texts have.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import features
from ..functions.vectors import hamming
from ..storage import materialize, numbered

MIN_CHARS, MAX_DISTANCE, RATIO, CONTAINED = 120, 8, 0.55, 0.8
#: Blocks of a fingerprint: (first bit, bits).
BLOCKS = [(0, 7), (7, 7), (14, 7), (21, 7), (28, 6), (34, 6), (40, 6), (46, 6), (52, 6), (58, 6)]
LEAST_WORDS = 20


def _hash(token: str, kind: str) -> int:
    raw = hashlib.md5(token.encode()).digest()[:8] if kind == "md5" else hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(raw, "big")


def fingerprints(docs: DataFrame, kind: str = "md5") -> DataFrame:
    """path, chars, fingerprint (null without words). kind: md5 or blake2b.

    A word weighs by the logarithm of its count, 6 at most; each hash bit votes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits: dict[str, np.ndarray] = {}
        for batch in batches:
            prints = []
            for words in batch["words"]:
                counts = Counter(words)
                if not counts:
                    prints.append(None)
                    continue
                if len(bits) > 300_000:
                    bits.clear()
                total = np.zeros(64, np.int64)
                for word, n in counts.items():
                    if (vote := bits.get(word)) is None:
                        vote = bits[word] = np.unpackbits(np.array([_hash(word, kind)], ">u8").view(np.uint8)).astype(np.int64) * 2 - 1
                    total += min(6, (n + 1).bit_length()) * vote  # 1 + floor(log2(n + 1))
                prints.append(int(np.packbits(total >= 0).view(">u8")[0].astype(np.uint64).view(np.int64)))
            yield pd.DataFrame({"path": batch["path"], "chars": batch["chars"], "fingerprint": pd.array(prints, dtype="Int64")})

    text = F.coalesce("text", F.lit(""))
    return docs.select("path", F.length(text).cast("long").alias("chars"), features(text).alias("words")).mapInPandas(run, "path string, chars long, fingerprint long")


def similar_pairs(docs: DataFrame, *, kind: str = "md5", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Linked pairs of representatives (left_path < right_path), their distance, and the class sizes.

    docs: path, text; leave exact copies out. Texts of fewer than MIN_CHARS
    characters take no part. A representative is the first path of a fingerprint
    and size.
    """
    signed = materialize(fingerprints(docs.filter(F.length(F.trim("text")) >= MIN_CHARS), kind).filter("fingerprint is not null"), "fingerprints")
    classes = materialize(signed.groupBy("fingerprint", "chars").agg(F.min("path").alias("path")), "classes")
    block = [F.shiftrightunsigned("fingerprint", first).bitwiseAND((1 << bits) - 1) for first, bits in BLOCKS]
    keys = [F.lit(i << 14) + block[a] * 128 + block[b] for i, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))]
    near = classes.select("path", "fingerprint", "chars", F.explode(F.array(*keys)).alias("key"))
    left, right = (near.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("path", "fingerprint", "chars"))) for side in ("left", "right"))
    apart = hamming(F.col("left_fingerprint"), F.col("right_fingerprint"))
    met = left.join(right, "key").filter((F.col("left_path") < F.col("right_path")) & (apart <= max_distance) & (_ratio() >= RATIO))
    direct = met.drop("key").distinct().withColumn("distance", apart)
    texts = docs.select("path", F.array_distinct(features(F.coalesce("text", F.lit("")))).alias("words")).join(classes, "path")
    texts = materialize(texts, "words")
    maybe = _containing(texts).filter((apart <= max_distance + 6) & (_ratio() < RATIO)).distinct().withColumn("distance", apart)
    words = texts.select("path", "words")
    unequal = maybe.join(words.withColumnsRenamed({"path": "left_path", "words": "lw"}), "left_path").join(words.withColumnsRenamed({"path": "right_path", "words": "rw"}), "right_path")
    least = F.least(F.size("lw"), F.size("rw"))
    contained = F.when(least >= LEAST_WORDS, F.size(F.array_intersect("lw", "rw")) / least).otherwise(0.0)
    linked = direct.unionByName(unequal.filter(contained >= CONTAINED).drop("lw", "rw"))
    return linked.select("left_path", "right_path", "distance", "left_fingerprint", "right_fingerprint", "left_chars", "right_chars")


def _containing(texts: DataFrame) -> DataFrame:
    """Pairs of which the one with fewer words has one of its rarest words in the other; left_path < right_path. texts: path, fingerprint, chars, words."""
    own = ["path", "fingerprint", "chars"]
    each = materialize(texts.filter(F.size("words") >= LEAST_WORDS).select(*own, F.size("words").alias("n"), F.explode("words").alias("word")), "each-word")
    uses = materialize(each.groupBy("word").agg(F.count("*").alias("uses")).filter("uses > 1"), "uses")
    rarest = F.row_number().over(W.partitionBy("path").orderBy(F.coalesce("uses", F.lit(1)), "word"))
    few = each.join(uses, "word", "left").withColumn("place", rarest).filter((F.col("place") <= F.floor(F.col("n") * (1 - CONTAINED) + 1e-9) + 1) & (F.col("uses") > 1))
    small_side = few.select("word", *(F.col(c).alias(f"a_{c}") for c in (*own, "n")))
    large_side = each.select("word", *(F.col(c).alias(f"b_{c}") for c in (*own, "n")))
    met = small_side.join(large_side, "word").filter((F.col("a_path") != F.col("b_path")) & (F.col("a_n") <= F.col("b_n")) & (F.least("a_chars", "b_chars") < RATIO * F.greatest("a_chars", "b_chars")) & (hamming(F.col("a_fingerprint"), F.col("b_fingerprint")) <= MAX_DISTANCE + 6))
    first = F.col("a_path") < F.col("b_path")
    return met.select(*(F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{side}_{c}") for side, x, y in (("left", "a", "b"), ("right", "b", "a")) for c in own))


def _ratio() -> Column:
    return F.least("left_chars", "right_chars") / F.greatest("left_chars", "right_chars")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of the links (a, b) reaches; labels jump ahead in each round."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "component").union(labels)
        low = near.groupBy("node").agg(F.min("component").alias("component"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = materialize(low.join(hop, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        still = new.join(labels.withColumnRenamed("component", "was"), "node").filter("component <> was").isEmpty()
        labels = new
        if still:
            return labels


def similar_groups(docs: DataFrame, *, kind: str = "md5") -> DataFrame:
    """One row for each document of a group of two or more: cluster_id, representative (the longest text), its distance from it.

    Groups are numbered by size and then by their first path.
    """
    pairs = materialize(similar_pairs(docs, kind=kind), "similar")
    signed = fingerprints(docs.filter(F.length(F.trim("text")) >= MIN_CHARS), kind).filter("fingerprint is not null").select("path", "chars", "fingerprint")
    signed = materialize(signed, "signed")
    heads = materialize(signed.groupBy("fingerprint", "chars").agg(F.min("path").alias("head")), "heads")
    members = signed.join(heads, ["fingerprint", "chars"])
    near = components(pairs.select(F.col("left_path").alias("a"), F.col("right_path").alias("b")))
    placed = materialize(members.join(near.select(F.col("node").alias("head"), "component"), "head", "left").withColumn("component", F.coalesce("component", "head")), "placed")
    groups = placed.groupBy("component").agg(F.count("*").alias("size"), F.min("path").alias("first_path"), F.max(F.struct("chars", "path", "fingerprint")).alias("top")).filter("size > 1")
    order = numbered(groups.select("component", "size", "first_path", "top"), [-F.col("size"), F.col("first_path")], "n")
    named = order.select("component", F.concat(F.lit("SIM-"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("cluster_id"), "size", F.col("top.path").alias("representative"), F.col("top.fingerprint").alias("anchor"))
    return placed.join(named, "component").select("cluster_id", "representative", "path", "size", hamming(F.col("fingerprint"), F.col("anchor")).alias("distance"))
