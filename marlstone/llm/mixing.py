"""Mixing sources to target weights (operator 13).

Each source gets a share of all words by its weight, but at most ``most`` times its
own words; what it can't take goes to the others by weight. A source's share says
how many copies of each of its documents the mix should hold: whole copies, and a
fraction. Dependent rounding by the pivotal method settles the fractions: two
documents of a source transfer words, in a random direction, until one fraction is
nought or one. The chances are such that each document's expected copies stay what
they were, and the words that a source gives don't change at all by a transfer.

One document with a fraction is left over, and it could be a large one. So large
documents go first: those with more than a ``head``-th of their source's words (so
fewer than ``head`` a source) are settled by size, from the largest, in steps of
two; the leftover of a step transfers words with all smaller documents, whose share
moves a little. Where the smaller ones can't make up for it, it is rounded to what
comes nearer to the target. All other documents are rounded by a reduction tree: a
task rounds each bucket of ``bucket_rows`` documents in one pass and hands on one
leftover; ``fan_in`` leftovers meet in the next level, until a source has one, which
is rounded by chance and is at most a ``head``-th of the source. Buckets, order and
chances come from hashes of the ids and from the data alone, so reruns agree on any
cluster.

Null text has no words, and a document without words none to take. A null source is
a source, the last one. Rows that repeat are documents each. An empty table gives an
empty result. Other columns of the input are left out.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import numbered
from .common import in_parts, materialize

#: A fraction this close to nought or one is that.
CLOSE = 1e-9


def pivot(a: float, s: int, b: float, t: int, chance: float) -> tuple[float, float]:
    """Fractions a and b of documents of s and t words after one transfer; one of them becomes nought or one."""
    up, down = min((1 - a) * s, b * t), min(a * s, (1 - b) * t)
    moved = up if chance * (up + down) < down else -down
    return _settled(a + moved / s), _settled(b - moved / t)


def _settled(x: float) -> float:
    return 0.0 if x < CLOSE else 1.0 if x > 1 - CLOSE else x


def round_large(sizes: list[int], target: float, pool: int, most: int, chances: random.Random) -> tuple[list[int], float]:
    """Copies of each document, by falling size, and the share that is left for ``pool`` words of smaller ones."""
    copies = [0] * len(sizes)
    words, left, at = sum(sizes) + pool, target, 0
    while at < len(sizes):
        step = [k for k in range(at, len(sizes)) if sizes[k].bit_length() == sizes[at].bit_length()]
        at = step[-1] + 1
        share = min(max(left / words, 0.0), float(most)) if words else 0.0
        whole = math.floor(share)
        carried, fraction = None, 0.0
        for k in step:
            copies[k], f = whole, _settled(share - whole)
            if 0 < f < 1 and carried is not None:
                fraction, f = pivot(fraction, sizes[carried], f, sizes[k], chances.random())
                if not 0 < fraction < 1:
                    copies[carried] += int(fraction)
                    carried = None
            if 0 < f < 1:
                carried, fraction = k, f
            else:
                copies[k] += int(f)
        words -= sum(sizes[k] for k in step)
        left -= sum(copies[k] * sizes[k] for k in step)
        if carried is not None:
            off = [max(-x, x - most * words, 0.0) for x in (left, left - sizes[carried])]
            if off[0] > off[1] or (off[0] == off[1] and chances.random() < fraction):
                copies[carried] += 1
                left -= sizes[carried]
    return copies, min(max(left / words, 0.0), float(most)) if words else 0.0


def source_targets(rows: DataFrame, most: int) -> DataFrame:
    """rows: source, size. A row for each source: number (from 1), source, n_docs, source_size, target."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = materialize(numbered(sums, [F.col("source").isNull(), F.coalesce("source", F.lit(""))], "number").withColumn("weight", (F.col("number") - 1) % 3 + 1), "sources")
    limit = F.col("source_size") * most
    whole = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words = whole["words"] or 0
    level, full = words / whole["weight"] if whole["weight"] else 0.0, 0
    while True:  # sources that are full stay so, as the level only rises
        over = F.col("weight") * F.lit(level) > limit
        found = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, limit)).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not found["n"] or found["n"] == full or not found["weight"]:
            break
        full, level = found["n"], (words - found["given"]) / found["weight"]
    share = F.col("weight") * F.lit(level)
    return sources.select("number", "source", "n_docs", "source_size", F.when(share > limit, limit.cast("double")).otherwise(share).alias("target"))


def _reduce(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """Rounds each node's documents in one pass. A row's ``copies`` are null where it is handed on with its fraction."""
    schema = rows.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, carried, chances, made, kinds = None, None, None, [], None

        def closed() -> None:
            if carried is not None:
                if last:
                    carried["whole"] += chances.random() < carried["fraction"]
                    carried["copies"] = carried["whole"]
                made.append(carried)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(made, schema=kinds)

        for batch in in_parts(batches):
            kinds = batch.schema
            for r in batch.to_pylist():
                if (at := (r["number"], r["node"])) != node:
                    closed()
                    node, carried, chances = at, None, random.Random(f"{seed}:{level}:{at[0]}:{at[1]}")
                f = r["fraction"]
                if 0 < f < 1 and carried is not None:
                    carried["fraction"], f = pivot(carried["fraction"], carried["size"], f, r["size"], chances.random())
                    if not 0 < carried["fraction"] < 1:
                        carried["copies"] = carried["whole"] + int(carried["fraction"])
                        made.append(carried)
                        carried = None
                if 0 < f < 1:
                    carried = r | {"fraction": f}
                else:
                    made.append(r | {"fraction": 0.0, "copies": r["whole"] + int(f)})
                if len(made) >= 10_000:
                    yield out()
                    made.clear()
        closed()
        if made:
            yield out()

    return rows.repartition("number", "node").sortWithinPartitions("number", "node", "place", "h", "size").select(names).mapInArrow(run, schema)


def mix_sources(docs: DataFrame, *, most: int = 3, head: int = 1000, bucket_rows: int = 10_000, fan_in: int = 64, seed: int = 42) -> DataFrame:
    """docs: doc_id, source, text. doc_id, size, source_size, target and taken for each row."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("h")), "sizes")
    sources = source_targets(rows, most)
    of_source = sources.withColumnRenamed("source", "name")
    placed = rows.join(of_source, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
    large = F.col("size") * head > F.col("source_size")
    result = ["doc_id", "size", "source_size", "target", "copies"]

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        """Fewer than ``head`` documents of one source. One row more, without a document, says what share the others have."""
        number = key[0].as_py()
        found = sorted(group.to_pylist(), key=lambda r: (-r["size"].bit_length(), r["h"], r["size"]))
        pool = found[0]["source_size"] - sum(r["size"] for r in found)
        copies, share = round_large([r["size"] for r in found], found[0]["target"], pool, most, random.Random(f"{seed}:{number}"))
        out = [{c: r[c] for c in result[:4]} | {"copies": n, "number": number, "share": None} for r, n in zip(found, copies, strict=True)]
        out.append(dict.fromkeys(result) | {"number": number, "share": share})
        kinds = {c: group.schema.field(c).type for c in result[:4]} | {"copies": pa.int64(), "number": pa.int64(), "share": pa.float64()}
        return pa.Table.from_pylist(out, schema=pa.schema(list(kinds.items())))

    schema = ", ".join([f"`doc_id` {dict(rows.dtypes)['doc_id']}", "size bigint", "source_size bigint", "target double", "copies bigint", "number bigint", "share double"])
    settled = materialize(placed.filter(large).select("number", "doc_id", "size", "source_size", "target", "h").groupBy("number").applyInArrow(settle, schema), "large")
    shares = sources.join(settled.filter("share is not null").select("number", "share"), "number", "left").select("number", F.col("source").alias("name"), "n_docs", "source_size", "target", F.coalesce("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("share"))
    shares = materialize(shares, "shares")
    small = rows.join(shares, F.col("source").eqNullSafe(F.col("name"))).filter(~large)
    empty = small.filter("size = 0").select(*result[:4], F.lit(0).cast("long").alias("copies"))
    buckets = F.ceil(F.col("n_docs") / bucket_rows)
    fraction = F.col("share") - F.floor("share")
    fraction = F.when(fraction < CLOSE, 0.0).when(fraction > 1 - CLOSE, 1.0).otherwise(fraction)
    nodes = small.filter("size > 0").select(*result[:4], "number", F.pmod(F.col("h"), buckets).cast("long").alias("node"), F.lit(0).cast("long").alias("place"), "h", F.floor("share").cast("long").alias("whole"), fraction.alias("fraction"), F.lit(None).cast("long").alias("copies"))
    widest = -(-(sources.agg(F.max("n_docs").alias("n")).first()["n"] or 1) // bucket_rows)
    done, level = [empty, settled.filter("share is null").select(result)], 0
    while True:
        rounded = materialize(_reduce(nodes, level, widest == 1, seed), "rounded")
        done.append(rounded.filter("copies is not null").select(result))
        if widest == 1:
            break
        nodes = rounded.filter("copies is null").withColumns({"place": F.col("node"), "node": F.floor(F.col("node") / fan_in)})
        level, widest = level + 1, -(-widest // fan_in)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select(*result[:4], (F.col("copies") * F.col("size")).alias("taken"))
