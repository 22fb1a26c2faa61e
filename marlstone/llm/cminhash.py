"""Near-duplicate groups by circulant MinHash (operator 6).

Words are lower-cased (A-Z), five in a row make a shingle, and documents with a
Jaccard similarity of at least 0.75 on their shingle sets are linked; groups
are the connected components of the links.

1. One pass over the texts gives each document its set's size, a 128-bit
   fingerprint of the set, and 32 band keys. All 128 signature coordinates come
   from two permutations: the first scatters shingles over 2**20 positions, the
   second gives the values, and coordinate k reads it shifted circularly by k.
2. Documents with one fingerprint have one set: they are one class, and only
   classes go on. Copies therefore cost one row each and never meet in pairs.
3. A band key shared by several classes is a bucket. Each member is first held
   against the bucket's centre, the member that meets most others, so a bucket of
   n members makes n - 1 pairs. Full sets decide.
4. Members of buckets that still hold more than one component meet again by
   their rarest shingles: the first quarter of a set, rarest first, has a shingle
   of the first quarter of every linked set, so no candidate link is lost, while
   passages that many documents share come last and bring no pairs. In each of
   these groups only members outside the largest component look for partners.
   After that every bucket pair is either in one component or is no link.

At 0.75 a pair shares no band with probability (1 - 0.75**4)**32 = 5e-6.
Sets are only built again for the classes in candidate pairs: a table of at
most 2**20 hash positions, so of a fixed size, sorts out the others at the scan.

Hot keys: a band key, a component or a set that very many rows share only ever
meets a written table with one row for each key, so Spark sees that table's size
and sends it to the tasks, or splits the hot key's rows.

Null or empty text has an empty set and no links; fewer than five words are one
shingle. A document is a doc_id: rows that repeat an id with other words belong
together, as if their texts were linked, and share one component; a row without
words stays by itself whatever its id. Rows with a null doc_id link others but
stay themselves. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, in_parts, materialize, only, released, texts_of, worker_cache

COORDINATES, BAND_ROWS = 128, 4
BANDS = COORDINATES // BAND_ROWS
UNIVERSE = 1 << 20
FILTER_BITS = 20
SIGNED = "doc_id bigint, n_shingles bigint, set_id binary, bands array<bigint>"

_tables: dict[str, np.ndarray] = worker_cache()


class _Words(dict):
    """64-bit hash of each word, kept while the task runs."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = worker_cache(_Words())


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and windows of the value permutation: row p holds the values at p, p + 1, ..."""
    if not _tables:
        rng = np.random.Generator(np.random.PCG64(20))
        _tables["scatter"] = rng.permutation(UNIVERSE).astype(np.int32)
        values = rng.permutation(UNIVERSE).astype(np.int32)
        _tables["values"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: COORDINATES - 1]]), COORDINATES)
    return _tables["scatter"], _tables["values"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(len(w), size), np.uint64)
    for k in range(min(size, len(w))):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    scatter, values = _permutations()
    out = np.full(COORDINATES, UNIVERSE, np.int32)
    for i in range(0, len(shingles), 4096):
        at = scatter[(shingles[i : i + 4096] & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        np.minimum(out, values[at].min(axis=0), out=out)
    return out


_BAND = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, whose lowest bits are the band's number."""
    h = _BAND.copy()
    for k in sig.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + k)
    return ((h & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def set_id(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


@released
def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only(_words, _tables)
    for batch in in_parts(batches):
        sizes, ids, bands, offsets = [], [], [], [0]
        for text in texts_of(batch):
            s = shingle_set(text)
            sizes.append(len(s))
            ids.append(set_id(s))
            if len(s):
                bands.append(band_keys(signature(s)))
            offsets.append(offsets[-1] + BANDS * bool(len(s)))
        keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), keys], names=["doc_id", "n_shingles", "set_id", "bands"])


@released
def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        sets = [shingle_set(t) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "shingles"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(ids: DataFrame, docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Full sets (set_id, shingles) of the set ids."""
    first = signed.filter("set_id is not null").groupBy("set_id").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("doc_id"))
    spot = F.xxhash64(F.coalesce("doc_id", F.lit(-1))).bitwiseAND((1 << FILTER_BITS) - 1)
    spots = ids.join(first, "set_id").select(spot.alias("spot")).distinct()  # 2**20 rows at most
    texts = docs.select("doc_id", "text", spot.alias("spot")).join(F.broadcast(spots), "spot", "left_semi").select("text")
    built = texts.mapInArrow(full_sets, "set_id binary, shingles binary").filter("set_id is not null").join(ids, "set_id", "left_semi")
    return materialize(built.groupBy("set_id").agg(F.max("shingles").alias("shingles")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that are linked on full sets."""
    both = pairs.join(sets.withColumnsRenamed({"set_id": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"set_id": "b", "shingles": "sb"}), "b")

    @released
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(column(batch, "sa").to_pylist(), column(batch, "sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(verify, "a binary, b binary")


def _uses(sets: DataFrame) -> np.ndarray:
    """How often shingles of each of 2**20 slots occur, a table of a fixed size."""
    slots = 1 << FILTER_BITS

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slots, np.int64)
        for batch in in_parts(batches):
            for x in column(batch, "shingles").to_pylist():
                np.add.at(n, (np.frombuffer(x, np.uint64) & np.uint64(slots - 1)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])

    found = sets.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def prefix_of(shingles: np.ndarray, uses: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, rarest first, of which every linked set has one among its own."""
    order = np.lexsort((shingles, uses[(shingles & np.uint64(len(uses) - 1)).astype(np.int64)]))
    return shingles[order[: len(shingles) + (percent * len(shingles)) // -100 + 1]]


def _rare_pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that can be linked: they share a shingle among the rarest of both.

    placed: set_id, part. Two linked sets have so many shingles in common that
    whatever the order of shingles, the first ones of both can't all differ.
    Common passages come last in the order and bring no pairs.
    """
    sent = sets.sparkSession.sparkContext.broadcast(_uses(sets))

    @released
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = [[], [], [], [], []]
            for i, (name, part, x) in enumerate(zip(column(batch, "set_id").to_pylist(), column(batch, "part").to_pylist(), column(batch, "shingles").to_pylist(), strict=True)):
                keys = prefix_of(np.frombuffer(x, np.uint64), sent.value, percent)
                rows[0].append(keys.view(np.int64))
                rows[1] += [name] * len(keys)
                rows[2] += [part] * len(keys)
                rows[3].append(np.full(len(keys), len(x) // 8))
                rows[4].append(np.arange(len(keys)))
                if len(rows[1]) > 200_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows[0])), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary()), pa.array(np.concatenate(rows[3])), pa.array(np.concatenate(rows[4]))], names=["rare", "set_id", "part", "n", "pos"])
                    rows = [[], [], [], [], []]

    listed = materialize(sets.join(placed, "set_id").mapInArrow(prefixes, "rare bigint, set_id binary, part binary, n bigint, pos bigint"), "prefixes")
    sizes = listed.groupBy("rare", "part").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("rare").agg(F.max(F.struct("k", "part")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("rare", F.col("top.part").alias("main"))
    met = materialize(listed.join(mixed, "rare"), "rare")
    # from the first shingle that both have, either must go on long enough to hold the overlap that a link needs,
    # so a row only meets sets of such sizes as it can still be linked with: sizes are part of the key, in steps of a tenth
    rest = F.col("n") - F.col("pos")
    most = F.least(F.ceil(F.col("n") * 100 / percent), F.floor(rest * (100 + percent) / percent) - F.col("n"))
    least = F.floor(F.col("n") * percent / 100)
    x = met.filter("part <> main").withColumns({"least": least, "most": most}).filter("most >= least and most >= 1")
    x = x.select("rare", F.explode(F.sequence(_step(F.greatest("least", F.lit(1))), _step(F.col("most")))).alias("step"), *(F.col(c).alias(f"x_{c}") for c in ("set_id", "part", "n", "pos")))
    y = met.select("rare", _step(F.col("n")).alias("step"), *(F.col(c).alias(f"y_{c}") for c in ("set_id", "part", "n", "pos")), (F.col("part") == F.col("main")).alias("y_main"))
    left = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    close = left * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent
    pairs = x.join(y, ["rare", "step"]).filter((F.col("x_part") != F.col("y_part")) & close)
    return pairs.select(F.least("x_set_id", "y_set_id").alias("a"), F.greatest("x_set_id", "y_set_id").alias("b")).distinct()


def _step(n: Column) -> Column:
    """Sizes in steps of a tenth."""
    return F.floor(F.ln(n.cast("double")) / math.log(1.1)).cast("int")


def _sized(x: Column, y: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node for each node of the links (a, b), by label propagation with pointer jumping until nothing changes."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label")
        lower = near.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(lower.join(of, "label", "left").select("node", F.least(F.col("label"), F.coalesce("next", "label")).alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count()
        labels = new
        if not changed:
            return labels


def _of_one_id(signed: DataFrame) -> DataFrame:
    """Links (a, b) between the first set of a document and its others, where rows repeat an id."""
    known = signed.filter("doc_id is not null and set_id is not null").select("doc_id", "set_id")
    several = materialize(known.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).filter("a <> z").drop("z"), "repeated")
    return known.join(several, "doc_id").filter("set_id <> a").select("a", F.col("set_id").alias("b"))


def near_duplicates(docs: DataFrame, *, percent: int = 75) -> DataFrame:
    """docs: doc_id, text. doc_id, n_shingles, component_id and kept for each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(sign, SIGNED), "signed")
    sets = signed.filter("set_id is not null").groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    members = sets.select("set_id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = materialize(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    buckets = materialize(members.join(shared, "bucket"), "buckets")
    weights = buckets.groupBy("set_id").agg(F.sum("n").alias("weight"))
    centres = materialize(buckets.join(weights, "set_id").groupBy("bucket").agg(F.max(F.struct("weight", "set_id", "n_shingles")).alias("centre")), "centres")
    met = buckets.join(centres, "bucket").filter((F.col("set_id") != F.col("centre.set_id")) & _sized(F.col("n_shingles"), F.col("centre.n_shingles"), percent))
    stars = materialize(met.select(F.least("set_id", "centre.set_id").alias("a"), F.greatest("set_id", "centre.set_id").alias("b")).distinct(), "stars")
    ids = stars.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    links = materialize(_verified(stars, _sets(ids, docs, signed), percent).union(_of_one_id(signed)), "links")
    near = components(links)

    placed = buckets.join(near.withColumnRenamed("node", "set_id"), "set_id", "left").select("bucket", "set_id", F.coalesce("label", "set_id").alias("part"))
    mixed = materialize(placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("bucket"), "mixed")
    open_sets = materialize(placed.join(mixed, "bucket", "left_semi").select("set_id", "part").distinct(), "open")
    if not open_sets.isEmpty():
        sets = _sets(open_sets.select("set_id"), docs, signed)
        rest = materialize(_rare_pairs(open_sets, sets, percent), "rest")
        found = materialize(_verified(rest, sets, percent), "rest-links")
        if not found.isEmpty():
            near = components(links.union(found))

    classes = signed.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    grouped = classes.join(near.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "least", F.coalesce("label", "set_id").alias("part"))
    grouped = materialize(grouped, "grouped")
    heads = materialize(grouped.groupBy("part").agg(F.min("least").alias("component_id")), "heads")
    of_set = materialize(grouped.join(heads, "part").select("set_id", "component_id"), "of-set")
    lonely = signed.filter("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = signed.filter("set_id is not null").join(of_set, "set_id").select("doc_id", "n_shingles", "component_id").union(lonely)
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
