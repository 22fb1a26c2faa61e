"""Spelling variant grouping (operator 11).

Words are counted over all texts; two words are near if one inserted, deleted or
replaced code point makes one from the other. The search is by Aho-Corasick over
halves: one edit leaves one of a word's two segments as it is, at the beginning
or at the end. All segments of all words stand in automata, and all words run
through them:

1. A segment is written with a mark where the word's edge is: ``#left`` for the
   first half, ``right#`` for the second. A word w runs through as ``w#w``, so a
   segment is only met at its own offset. Its word's length must be w's or one
   less (the shorter word of a pair is the one that is held), and the words that
   are left are compared in full.
2. The automata are shards: a segment's hash gives its shard, and a word visits
   the shards of the segments that it can hold (at most four), so each shard sees
   the words that matter to it and no word more. Spark sorts a shard's rows,
   segments first, and a task builds the automaton and streams the words through.
3. Segments of a length that very many words share, whether held or passing
   through, are made longer: what lies between the segments known to be the same
   is halved again, and the literal becomes ``right#left``. Each step takes two
   rows for a word instead of one and splits the group, down to words that differ
   in one place, which the alphabet bounds. So nothing is capped, no link is lost,
   and no group of pairs grows with its square.

Only links leave the tasks. A word's form is its near word of largest count, if
that is ``ratio`` times its own or more; the root follows forms to the last. Counts
grow along the way, so the way ends after a few steps; it is doubled in each round.

Null text has no words. A null id counts as an empty one. Rows that repeat count
each. Texts without long enough words, and empty tables, give no rows. Other
columns of the input are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, in_parts, materialize, texts_of

#: The letters of a run, and the rule by which letters are taken out.
LETTERS = "a-zÀ-ÿ"
DROP_EACH = 199
FLUSH_WORDS = 200_000
#: Candidate pairs that are compared at once, in bytes.
COMPARED = 1 << 22
FOUND = "a string, b string, n_a bigint, n_b bigint"
FRAMES = "kind", "word", "n", "size", "i", "j"


def counted_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Uses of each word of at least so many code points; a letter is taken out of some runs, chosen by checksum."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}").findall
    counts: Counter[str] = Counter()
    held = 0
    for batch in in_parts(batches):
        for name, text in zip(column(batch, "name").to_pylist(), texts_of(batch), strict=True):
            start = zlib.crc32(f"{name}:".encode())
            for run, n in Counter(runs(text.lower().decode("utf-8", "replace"))).items():
                h = zlib.crc32(run.encode(), start)
                if h % DROP_EACH == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < least:
                        continue
                counts[run] += n
            held += len(text)
            if len(counts) > FLUSH_WORDS or held > 1 << 27:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                counts.clear()
                held = 0
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one edit; long has as many columns as short, or one more."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(axis=1) == 1
    ends = np.zeros((len(short), 1), bool)
    first = np.argmin(np.hstack([short == long[:, :n], ends]), axis=1)
    last = np.argmin(np.hstack([(short == long[:, 1:])[:, ::-1], ends]), axis=1)
    return first + last >= n


class Shard:
    """One automaton over segments, and the words that hold them, as (word, count) by segment and word length."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        self.owners: dict[str, dict[int, list[int]]] = {}
        self.words: list[tuple[str, int]] = []
        self.ready = False

    def hold(self, literal: str, word: str, n: int) -> None:
        self.owners.setdefault(literal, {}).setdefault(len(word), []).append(len(self.words))
        self.words.append((word, n))

    def made(self) -> None:
        for literal, owners in self.owners.items():
            self.automaton.add_word(literal, {size: np.array(at) for size, at in owners.items()})
        if self.owners:
            self.automaton.make_automaton()
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(w) for w, _ in self.words])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            place = np.full(len(self.words), -1)
            place[at] = np.arange(len(at))
            self.rows[int(size)] = place, _letters([self.words[i][0] for i in at], int(size))
        self.ready = True

    def links(self, passing: list[tuple[str, int]]) -> Iterator[tuple[str, str, int, int]]:
        """Near pairs of held and passing words; of two words of one length, the passing one is the later."""
        if not self.owners:
            return
        met: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        cells: Counter[tuple[int, int]] = Counter()
        for k, (word, _) in enumerate(passing):
            for _, owners in self.automaton.iter(f"{word}#{word}"):
                for size in (len(word), len(word) - 1):
                    if (at := owners.get(size)) is not None:
                        kind = size, len(word)
                        met.setdefault(kind, []).append((at, k))
                        cells[kind] += len(at) * size
                        if cells[kind] > COMPARED:
                            yield from self._compared(kind, met.pop(kind), passing)
                            cells[kind] = 0
        for kind, some in met.items():
            yield from self._compared(kind, some, passing)

    def _compared(self, kind: tuple[int, int], some: list[tuple[np.ndarray, int]], passing: list[tuple[str, int]]) -> Iterator[tuple[str, str, int, int]]:
        size, other = kind
        a = np.concatenate([at for at, _ in some])
        b = np.repeat([k for _, k in some], [len(at) for at, _ in some])
        place, letters = self.rows[size]
        own, at = np.unique(b, return_inverse=True)
        near = one_edit(letters[place[a]], _letters([passing[k][0] for k in own], other)[at])
        for x, k in set(zip(a[near].tolist(), b[near].tolist(), strict=True)):
            (word, n), (text, m) = self.words[x], passing[k]
            if size < other or word < text:
                yield word, text, n, m


def _letters(words: list[str], size: int) -> np.ndarray:
    """Words of one length as rows of code points, all below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), size)


def scan_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, those to hold (kind 0) before those that pass (kind 1)."""
    at, shard = None, Shard()

    def out(passing: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
        found = list(set(shard.links(passing)))
        for i in range(0, len(found), 50_000):
            cols = list(zip(*found[i : i + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["a", "b", "n_a", "n_b"])

    for batch in in_parts(batches, 10_000):
        passing: dict[tuple[str, int], None] = {}
        for number, kind, literal, word, n in zip(*(column(batch, c).to_pylist() for c in ("shard", "kind", "literal", "word", "n")), strict=True):
            if number != at:
                yield from out(list(passing))
                passing, at, shard = {}, number, Shard()
            if kind == 0:
                shard.hold(literal, word, n)
            else:
                if not shard.ready:
                    shard.made()
                passing[word, n] = None
        yield from out(list(passing))


def _literal() -> Column:
    """What lies before and behind the part that may differ, written from the end's side: ``right#left``."""
    return F.concat(F.expr("right(word, j)"), F.lit("#"), F.expr("left(word, i)"))


def _halves(i: Column, j: Column, size: Column) -> Column:
    """Both ways to halve the part of a word of that size between the first i and the last j letters."""
    gap = size - i - j
    half = F.floor(gap / 2).cast("int")
    way = lambda a, b: F.struct(a.cast("int").alias("i"), b.cast("int").alias("j"))
    return F.array(way(i + half, j), way(i, j + gap - half))


def near_words(words: DataFrame, *, shard_words: int = 20_000, hot: int = 20_000) -> DataFrame:
    """words: word, n, each word once. All near pairs (a, b, n_a, n_b), each once.

    hot: words held times words passing by that a segment of one length may have
    before it is made longer.
    """
    size = F.length("word")
    none = F.lit(0)
    held = words.select(F.lit(0).alias("kind"), "word", "n", size.alias("size"))
    passing = words.select(F.lit(1).alias("kind"), "word", "n", F.explode(F.array(size, size - 1)).alias("size")).filter("size > 0")
    frames = held.union(passing).withColumn("way", F.explode(_halves(none, none, F.col("size")))).select(*FRAMES[:4], "way.i", "way.j").withColumn("literal", _literal())
    ready = None
    while True:
        frames = materialize(frames, "frames")
        met = frames.groupBy("literal", "size").agg(F.count_if(F.col("kind") == 0).alias("n_held"), F.count_if(F.col("kind") == 1).alias("n_passing"), F.first(F.col("size") - F.col("i") - F.col("j")).alias("gap"))
        crowded = materialize(met.filter((F.col("n_held") * F.col("n_passing") > hot) & (F.col("gap") > 1)).select("literal", "size"), "crowded")
        if crowded.isEmpty():
            ready = frames if ready is None else ready.union(frames)
            break
        rest = frames.join(crowded, ["literal", "size"], "left_anti").select(frames.columns)
        ready = rest if ready is None else ready.union(rest)
        longer = frames.join(crowded, ["literal", "size"], "left_semi")
        frames = longer.withColumn("way", F.explode(_halves(F.col("i"), F.col("j"), F.col("size")))).select(*FRAMES[:4], "way.i", "way.j").withColumn("literal", _literal())
    shards = max(1, -(-words.count() // shard_words))
    dealt = ready.select(F.pmod(F.xxhash64("literal"), F.lit(shards)).alias("shard"), "kind", "literal", "word", "n")
    parts = max(shards, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))) if shards > 1 else 1
    return dealt.repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(scan_shards, FOUND).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """forms: word, form. The last form on the way from each word; the way is doubled in each round."""
    last = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        of = last.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(last.join(of, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if further.filter("moved").isEmpty():
            return last
        last = further.select("word", "root")


def spelling_variants(docs: DataFrame, *, least_letters: int = 6, least_uses: int = 5, ratio: int = 5, shard_words: int = 20_000, hot: int = 20_000) -> DataFrame:
    """docs: doc_id, text. word, form, root, n, n_near and form_n for each word."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    counted = rows.mapInArrow(lambda it: counted_words(it, least_letters), "word string, n bigint")
    words = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_uses), "words")
    pairs = near_words(words, shard_words=shard_words, hot=hot)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    near = materialize(sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")), "near")
    judged = words.join(near, "word", "left").withColumn("has", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    judged = materialize(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.other")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n")), "judged")
    roots = _roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
