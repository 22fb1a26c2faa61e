"""Target-distribution importance resampling (operator 12).

Documents are drawn as if they came from a target text collection. A text's
features are its runs of one to three words, hashed into a fixed number of
buckets. All documents' and all target texts' uses of each bucket are counted by
Spark, and an array of one gain for each bucket scores the documents: the weight is
the sum over a text's features. Noise of the Gumbel law, by a hash of the id, makes
the highest scores a draw without replacement in proportion to the weights.

The draw is an external merge:

1. Each partition's eligible rows are sorted by Spark: a run. Runs are cut into
   blocks of ``block_rows`` rows (keys only) and written.
2. Scores are cut into ranges, each of about ``range_rows`` drawn rows, so the merge
   is shared out; how many rows a range has is counted exactly, which gives the rank
   that it begins with, and ranges that begin after the draw count are not read.
3. In each range a k-way tournament tree merges the runs. Blocks come in the order
   of their first rows and enter the tree when that row can be the next, so a task
   holds one block for each run at most. The last range stops at the exact draw
   count.

The last row that was drawn tells drawn and undrawn rows apart, so that no join is
needed.

Null text has no words. A null id hashes as empty and comes after all others.
Rows that repeat count each; rows of one score and id are drawn in any order,
which doesn't show. With no rows, or too few, nothing is drawn; with an empty
target the gains are those of no uses. Ids are whole numbers. Other columns of the
input are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, in_parts, materialize, texts_of
from .decontam import words_of

#: Bytes of a word up to which checksums are combined by tables; words kept with their checksums.
LONGEST, KEPT_WORDS = 64, 200_000
LAST = (1 << 63) - 1
KEYS = ("score", "id", "row")

_shifts: list[np.ndarray] = []


def _shift_tables() -> np.ndarray:
    """By a number of bytes, four tables of 256: what a checksum becomes when so many zero bytes follow it.

    A checksum of two strings in a row is the first one's, moved on by the second
    one's length, xor the second one's, so runs of words need no second look at
    their bytes.
    """
    if not _shifts:
        one = np.array([zlib.crc32(bytes([0]), i) ^ zlib.crc32(bytes([0])) for i in (1 << np.arange(32)).tolist()], np.uint32)  # each bit moved on by a byte
        image, tables = 1 << np.arange(32, dtype=np.uint32), np.zeros((LONGEST + 2, 4, 256), np.uint32)
        for n in range(LONGEST + 2):
            for k in range(4):
                for bit in range(8):
                    tables[n, k] ^= np.where(np.arange(256) >> bit & 1, image[8 * k + bit], 0).astype(np.uint32)
            image = np.bitwise_xor.reduce(np.where(image[:, None] >> np.arange(32, dtype=np.uint32) & 1, one[None, :], 0).astype(np.uint32), axis=1)
        _shifts.append(tables)
    return _shifts[0]


def _followed(crc: np.ndarray, size: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksum of what has the checksum crc with strings of these sizes and checksums behind it."""
    tables = _shift_tables()
    out = by.copy()
    for k in range(4):
        out ^= tables[size, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class _Sums(dict):
    """Places of words in arrays of their checksum, of the checksum of the word and a blank, and of their size; kept while the task runs."""

    def __init__(self):
        self.arrays = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at == len(self.arrays[0]):
            self.arrays = tuple(np.concatenate([a, np.zeros_like(a)]) for a in self.arrays)
        c = zlib.crc32(word)
        self.arrays[0][at], self.arrays[1][at], self.arrays[2][at] = c, zlib.crc32(b" ", c), len(word)
        return at

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self) > KEPT_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return tuple(a[at] for a in self.arrays)


_sums = _Sums()


def features_of(texts: list[list[bytes]], longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Checksums of all runs of one to ``longest`` words of one text, joined by a blank, and the texts' numbers."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = [w for text in texts for w in text]
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    c, opened, size = _sums.of(words)
    owner, with_blank = np.repeat(np.arange(len(texts)), sizes), opened
    out, owners = [c], [owner]
    long = size > LONGEST
    for n in range(1, min(longest, len(words))):  # opened: runs of n words and a blank, from each word on
        inside = owner[n:] == owner[:-n]
        step = np.minimum(size[n:], LONGEST)
        runs = _followed(opened[: len(words) - n], step, c[n:])
        opened = _followed(opened[: len(words) - n], step + 1, with_blank[n:])
        for i in np.flatnonzero(np.lib.stride_tricks.sliding_window_view(long, n + 1).any(axis=1)) if long.any() else ():
            runs[i], opened[i] = zlib.crc32(b" ".join(words[i : i + n + 1])), zlib.crc32(b" ".join([*words[i : i + n + 1], b""]))
        out.append(runs[inside])
        owners.append(owner[n:][inside])
    return np.concatenate(out), np.concatenate(owners)


def parts_of(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows with their words, in parts of about as many bytes."""
    for batch in in_parts(batches):
        texts, first, held = texts_of(batch), 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held > most or i == len(texts) - 1:
                yield batch.slice(first, i + 1 - first), [words_of(t) for t in texts[first : i + 1]]
                first, held = i + 1, 0


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Uses of each bucket in all texts, an array of a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for _, words in parts_of(batches):
            n += np.bincount(features_of(words)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandfold log ratio of the target's and the documents' smoothed frequency of each bucket, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def score_texts(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""
    gains = docs.sparkSession.sparkContext.broadcast(gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in parts_of(batches):
            found, owner = features_of(words)
            weight = np.zeros(len(words), np.int64)
            np.add.at(weight, owner, gains.value[found % np.uint32(buckets)])
            cols = [np.fromiter(map(len, words), np.int64, len(words)), np.bincount(owner, minlength=len(words)), weight]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


class Tournament:
    """Winner tree over sorted blocks; each leaf holds one block's next key, and the root the least of all."""

    NONE = (math.inf,)

    def __init__(self):
        self.leaves = 1
        self.tree: list[tuple] = [(self.NONE, 0)] * 2
        self.blocks: list[Iterator[tuple] | None] = [None]
        self.free = [0]

    def enter(self, block: Iterator[tuple]) -> None:
        """A block takes a free leaf; the tree doubles where there is none."""
        if not self.free:
            n = self.leaves
            self.leaves *= 2
            self.free = list(range(2 * n - 1, n - 1, -1))
            self.blocks += [None] * n
            keys = self.tree[n:] + [(self.NONE, i) for i in range(n, 2 * n)]
            self.tree = [(self.NONE, 0)] * self.leaves + keys
            for i in range(self.leaves - 1, 0, -1):
                self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])
        leaf = self.free.pop()
        self.blocks[leaf] = block
        self._play(leaf)

    def _play(self, leaf: int) -> None:
        """The leaf's next key plays its way up."""
        key = next(self.blocks[leaf], self.NONE)
        if key is self.NONE:
            self.blocks[leaf] = None
            self.free.append(leaf)
        at = leaf + self.leaves
        self.tree[at] = (key, leaf)
        while at > 1:
            at //= 2
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    @property
    def least(self) -> tuple:
        return self.tree[1][0]

    def pop(self) -> tuple:
        key, leaf = self.tree[1]
        self._play(leaf)
        return key


def merged(blocks: Iterator[tuple[tuple, Iterator[tuple]]]) -> Iterator[tuple]:
    """Keys of sorted blocks in order; blocks come by their first key."""
    tree = Tournament()
    for first, block in blocks:
        while tree.least < first:
            yield tree.pop()
        tree.enter(block)
    while tree.least is not Tournament.NONE:
        yield tree.pop()


def _cut_runs(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition, as blocks of rows of one range: a row for each block, with its first key and all its values."""
    waiting: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(waiting).combine_chunks()
        cols = [t[c].to_numpy() for c in ("range", *KEYS, "n_features", "weight")]
        values = np.ascontiguousarray(np.stack(cols[1:])).astype(np.int64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array(cols[0][:1]), *(pa.array(c[:1]) for c in cols[1:4]), pa.array([values], pa.binary())], names=["range", *KEYS, "block"])

    held, at = 0, None
    for batch in batches:
        ranges = column(batch, "range").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            while a < b:
                if held and (held == block_rows or at != ranges[a]):
                    yield out()
                    waiting, held = [], 0
                n = min(b - a, block_rows - held)
                waiting.append(batch.slice(a, n))
                at, held, a = ranges[a], held + n, a + n
    if held:
        yield out()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, Iterator[tuple]]]:
    for batch in in_parts(batches, 64):
        for r in zip(*(column(batch, c) for c in ("range", *KEYS, "block")), strict=True):
            at, *first = (x.as_py() for x in r[:4])
            values = np.frombuffer(r[4].as_py(), np.int64).reshape(5, -1)
            yield at, (-first[0], *first[1:]), zip((-values[0]).tolist(), *(v.tolist() for v in values[1:]), strict=True)


def draw(scored: DataFrame, *, percent: int = 5, least_words: int = 20, range_rows: int = 100_000, block_rows: int = 4096) -> DataFrame:
    """scored: the rows of score_texts. All rows, with ``rank`` for the drawn ones."""
    spark = scored.sparkSession
    rows = materialize(scored.withColumn("row", F.monotonically_increasing_id()).withColumn("id", F.coalesce("doc_id", F.lit(LAST))), "scored")
    eligible = rows.filter(F.col("n_words") >= least_words)
    n = eligible.count()
    wanted = percent * n // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    # from the highest score down, each range holds about as many of the wanted rows; where the cuts lie changes no result
    parts = min(1024, -(-wanted // range_rows))
    cuts = sorted({int(x) for x in eligible.select(F.percentile_approx("score", [1 - i * wanted / n / parts for i in range(1, parts + 1)], 100_000).alias("c")).first()["c"]}, reverse=True)
    sent = F.array(*map(F.lit, cuts))
    ranged = eligible.withColumn("range", F.size(F.filter(sent, lambda c: c > F.col("score"))).cast("long"))
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # a row for each range
    begins, upto = {}, 0
    for k in range(len(cuts) + 1):
        if upto < wanted and k in sizes:
            begins[k] = upto
        upto += sizes.get(k, 0)
    by_key = [F.desc("score"), F.asc("id"), F.asc("row")]
    runs = ranged.filter(F.col("range") <= max(begins)).select("range", *KEYS, "n_features", "weight").sortWithinPartitions("range", *by_key)
    blocks = materialize(runs.mapInArrow(lambda it: _cut_runs(it, block_rows), "range bigint, score bigint, id bigint, row bigint, block binary"), "runs")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opened(batches)
        ahead = next(opened, None)
        while ahead:
            at = ahead[0]

            def of_range(at=at) -> Iterator[tuple[tuple, Iterator[tuple]]]:
                nonlocal ahead
                while ahead and ahead[0] == at:
                    yield ahead[1:]
                    ahead = next(opened, None)

            rank, made = begins[at], []
            for less, doc, row, features, weight in merged(of_range()):
                rank += 1
                made.append((doc, row, features, weight, -less, rank))
                if len(made) == 10_000 or rank == wanted:
                    yield _ranked(made)
                    made = []
                if rank == wanted:
                    break
            if made:
                yield _ranked(made)
            while ahead and ahead[0] == at:  # what the last range has beyond the draw
                ahead = next(opened, None)

    dealt = blocks.repartition(max(1, len(begins)), "range").sortWithinPartitions("range", *by_key)
    drawn = materialize(dealt.mapInArrow(merge, "id bigint, row bigint, n_features bigint, weight bigint, score bigint, rank bigint"), "drawn")
    last = drawn.filter(F.col("rank") == wanted).first()
    after = (F.col("score") < last["score"]) | ((F.col("score") == last["score"]) & (F.struct("id", "row") > F.struct(F.lit(last["id"]).alias("id"), F.lit(last["row"]).alias("row"))))
    others = rows.filter((F.col("n_words") < least_words) | after).select(*out, F.lit(None).cast("long").alias("rank"))
    return drawn.select(F.when(F.col("id") < LAST, F.col("id")).alias("doc_id"), *out[1:], "rank").union(others)


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "row", "n_features", "weight", "score", "rank"])


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, range_rows: int = 100_000, block_rows: int = 4096) -> DataFrame:
    """docs: doc_id, text; target: text. doc_id, n_features, weight, score and rank for each row of docs."""
    return draw(score_texts(docs, target, buckets=buckets, seed=seed), percent=percent, least_words=least_words, range_rows=range_rows, block_rows=block_rows)
