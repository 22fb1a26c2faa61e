"""K-d tree sharding (operator 3), DataFrame functions only.

A node is cut across its widest metadata dimension at the weighted median of
that dimension, the weight being the row's bytes, until there are as many
leaves as asked for, or, with a target, until every leaf has at most the target
bytes (but for a single larger row). Dimensions are size, language, source and
id, each scaled to one range, so "widest" compares like with like; ties go to
the first in that order. Sizes and ids are scaled between the ends of the table.
Languages and sources are coded by weighted rank: a value stands at the share of
all bytes that the values before it have, so that a cut keeps values together
that sort together. Rows with one value are parted by a hash of the row, so that
a hot source or a large group of copies never has to stay in one leaf.

All nodes of a level are cut together, whatever their number: the bytes of at
most ``BINS`` intervals a node are summed, the interval that holds the median is
cut again, and so on until it is small enough. What is known of the nodes stays
in tables of a row for each node, which are broadcast while they are small, and
rows are written anew once in ``LEVELS`` levels. Both sides of a cut have rows.
Leaves are numbered from left to right.

An odd number of leaves is cut in proportion; with fewer rows than leaves there
are fewer leaves. Null text has no bytes, a null dimension sorts first, repeated
rows are placed each, an empty table gives an empty result; other columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import numbered, running_sum
from .common import materialize

BINS = 1024
#: Values of a dimension take 36 bits, the row's hash 24 more.
RANGE, TIE = 1 << 36, 1 << 24
DIMS = ("size", "lang", "source", "id")
#: Tables of at most so many nodes, and dictionaries of at most so many bytes, are broadcast.
BROADCAST_NODES, BROADCAST_BYTES = 100_000, 32 << 20
#: Rows are written after so many levels.
LEVELS = 4


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """The rows with ``r_name``: the bytes of all rows whose value sorts before this one's, null first."""
    values = rows.groupBy(name).agg(F.sum("size").alias("bytes"))
    codes = materialize(running_sum(values, [name], F.col("bytes"), "upto").select(F.col(name).alias("value"), (F.col("upto") - F.col("bytes")).alias(f"r_{name}")), "codes")
    room = codes.agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 64).alias("bytes")).first()["bytes"] or 0
    return rows.join(F.broadcast(codes) if room <= BROADCAST_BYTES else codes, F.col(name).eqNullSafe(F.col("value")), "left").drop("value")


def _scaled(value: Column, lo: int, hi: int) -> Column:
    return F.floor((value - F.lit(lo)).cast("double") / max(1, hi - lo) * (RANGE - 1)).cast("long")


def _items(docs: DataFrame) -> DataFrame:
    """uid, doc_id, size, text_crc32 and a coordinate for each dimension."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    raw = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            size.alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"),
        ),
        "items",
    )
    known = F.coalesce("doc_id", F.lit(-1))
    ends = raw.agg(F.min("size").alias("lo_size"), F.max("size").alias("hi_size"), F.min(known).alias("lo_id"), F.max(known).alias("hi_id"), F.sum("size").alias("bytes")).first()
    at = lambda name: ends[name] or 0
    places = {
        "size": _scaled(F.col("size"), at("lo_size"), at("hi_size")),
        "lang": _scaled(F.col("r_lang"), 0, at("bytes")),
        "source": _scaled(F.col("r_source"), 0, at("bytes")),
        "id": _scaled(known, at("lo_id"), at("hi_id")),
    }
    tie = F.xxhash64("uid").bitwiseAND(TIE - 1)
    coded = _ranked(_ranked(raw, "lang"), "source")
    return coded.select("uid", "doc_id", "size", "text_crc32", *((places[d] * TIE + tie).alias(f"k_{d}") for d in DIMS))


def _near(nodes: DataFrame, count: int) -> DataFrame:
    return F.broadcast(nodes) if count <= BROADCAST_NODES else nodes


def _key() -> Column:
    return F.element_at(F.array(*(f"k_{d}" for d in DIMS)), F.col("dim"))


def _cuts(items: DataFrame, nodes: int, target: int | None, tolerance: float) -> DataFrame | None:
    """path, leaves, dim, cut for each open node of two leaves or more: its widest dimension and the largest coordinate that goes left."""
    ends = [f(f"k_{d}").alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
    leaves = F.expr(f"(sum(size) + {target - 1}) div {target}") if target else F.min("leaves").cast("long")
    spans = items.filter("open").groupBy("path").agg(leaves.alias("leaves"), F.sum("size").alias("bytes"), *ends).filter("leaves > 1")
    width = lambda d: F.expr(f"hi_{d} div {TIE} - lo_{d} div {TIE}")
    widest = F.array_max(F.array(*(F.struct(width(d).alias("w"), F.lit(-i).alias("i"), F.col(f"lo_{d}").alias("lo"), F.col(f"hi_{d}").alias("hi")) for i, d in enumerate(DIMS))))
    goal = F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    active = spans.withColumn("x", widest).select(
        "path", "leaves", (1 - F.col("x.i")).alias("dim"), F.col("x.lo").alias("least_of_all"), F.col("x.hi").alias("most_of_all"),
        goal.alias("goal"), (F.col("bytes") * tolerance).alias("slack"), "x.lo", "x.hi", F.lit(0).cast("long").alias("before"),
    ).filter("lo < hi")
    active, found = materialize(active, "active"), None
    by = ["path", "leaves", "dim", "least_of_all", "most_of_all", "goal", "slack", "before"]
    while not active.isEmpty():
        inside = items.filter("open").select("path", "size", *(f"k_{d}" for d in DIMS)).join(_near(active.withColumnRenamed("path", "node"), nodes), F.col("path") == F.col("node")).withColumn("key", _key()).filter("key between lo and hi")
        bins = inside.groupBy(*by, F.expr(f"(key - lo) div ((hi - lo) div {BINS} + 1)").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("least"), F.max("key").alias("most"))
        order = W.partitionBy("path").orderBy("bin")
        summed = bins.withColumns({"upto": F.col("before") + F.sum("bytes").over(order), "last": F.lead("bin").over(order).isNull()})
        held = summed.filter(F.col("last") | (F.col("upto") >= F.col("goal"))).groupBy(*by).agg(F.min_by(F.struct("bytes", "rows", "least", "most", "upto"), "bin").alias("b"))
        start = F.col("b.upto") - F.col("b.bytes")
        done = (F.col("b.rows") == 1) | (F.col("b.bytes") <= F.col("slack")) | (F.col("b.least") == F.col("b.most"))
        # the whole interval goes to the side that it overshoots less, but no side stays empty
        right = F.col("goal") - start < F.col("b.upto") - F.col("goal")
        right = (right & (F.col("b.least") > F.col("least_of_all"))) | (F.col("b.most") == F.col("most_of_all"))
        cut = F.when(right, F.col("b.least") - 1).otherwise(F.col("b.most"))
        # a single value of a hot source shrinks to the range of its hashes at once
        now = [x for x in by if x != "before"]
        held = materialize(held.select(*now, start.alias("before"), F.col("b.least").alias("lo"), F.col("b.most").alias("hi"), F.when(done, cut).alias("cut")), "held")
        new = held.filter("cut is not null").select("path", "leaves", "dim", "cut")
        found = new if found is None else found.union(new)
        active = held.filter("cut is null").drop("cut")
    return found


def shard_documents(docs: DataFrame, *, shards: int | None = None, target_bytes: int = 1 << 27, tolerance: float = 1e-4, slot_rows: int = 200_000) -> DataFrame:
    """docs: doc_id, text, lang, source. One row for each: shard from 0, slot from 0 without gaps in each shard.

    With ``shards`` there are so many leaves, else as many as ``target_bytes`` asks for.
    """
    target = None if shards else max(1, target_bytes)
    # a node is known by the turns that lead to it; open ones may be cut
    placed = materialize(_items(docs).withColumns({"path": F.lit(""), "leaves": F.lit(shards or 0).cast("long"), "open": F.lit(True)}), "placed")
    nodes, level = 1, 0
    while (found := _cuts(placed, nodes, target, tolerance)) is not None:
        cuts = materialize(found.select(F.col("path").alias("node"), F.col("leaves").alias("parts"), "dim", "cut"), "cuts")
        nodes, level = 2 * cuts.count(), level + 1
        met = placed.join(_near(cuts, nodes), F.col("path") == F.col("node"), "left")
        half = F.floor(F.col("parts") / 2)
        left, here = _key() <= F.col("cut"), F.col("cut").isNotNull()
        placed = met.select(
            "uid", "doc_id", "size", "text_crc32", *(f"k_{d}" for d in DIMS),
            F.when(here, F.concat("path", F.when(left, "0").otherwise("1"))).otherwise(F.col("path")).alias("path"),
            F.when(here, F.when(left, half).otherwise(F.col("parts") - half)).otherwise(F.col("leaves")).alias("leaves"),
            here.alias("open"),
        )
        if level % LEVELS == 0 or nodes > BROADCAST_NODES:
            placed = materialize(placed, "placed")
    rows = materialize(placed.groupBy("path").agg(F.count("*").alias("rows")), "leaves")
    leaves = materialize(numbered(rows, ["path"], "n").select(F.col("path").alias("leaf"), (F.col("n") - 1).cast("int").alias("shard"), F.expr(f"rows div {slot_rows} + 1").alias("buckets")), "shards")
    # slots: rows are numbered in buckets of a bounded size, after the rows of the buckets before
    placed = placed.join(_near(leaves, leaves.count()), F.col("path") == F.col("leaf")).select("uid", "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("uid"), F.col("buckets")).alias("bucket"))
    placed = materialize(placed, "slots")
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = materialize(sizes.select(F.col("shard").alias("b_shard"), F.col("bucket").alias("b_bucket"), (F.sum("rows").over(W.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("before")), "before")
    in_bucket = placed.withColumn("in_bucket", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "uid")))
    joined = in_bucket.join(_near(before, before.count()), (F.col("shard") == F.col("b_shard")) & (F.col("bucket") == F.col("b_bucket")))
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("in_bucket") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
