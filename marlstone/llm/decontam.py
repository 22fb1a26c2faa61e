"""Benchmark decontamination (operator 10).

Benchmark items are normalised to words and cut into windows of ten words (an
item of fewer is one window). One Aho-Corasick automaton holds all windows; it
runs over a document's words once and marks the words inside any occurrence.
Words stand in the automaton as pairs of characters, one pair for each word of
the benchmark; words that it doesn't have break any match. Hits are mapped back to
the characters of the original text.

The automaton goes to every worker, which builds it once and holds one at a
time, so its size is bounded: it has at most ``block_words`` words. Usual
benchmarks fit into one. A larger one is cut into blocks; the documents are then
scanned once for each block, what a block finds is written, and the blocks'
findings meet by row. An item of more words than a block is cut too, its pieces
overlapping by a window less one word.

Null text has no words, so no windows and no hits. Items with a null id are left
out. Items or documents that repeat count each; an item found under one id twice
is one item. Empty tables give no hits or no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import running_sum
from .common import column, in_parts, materialize, only, released, texts_of, worker_cache

#: Bytes of words: digits, lower-case letters and all beyond ASCII; the others become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A word that no item has; where the two alphabets begin.
OUTSIDE, FIRST, SECOND = "\0\0", 0x1000, 0x3000
FOUND = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<first:int,last:int>>"
HITS = "uid bigint, item_ids array<string>, ranges array<struct<first:int,last:int>>"
ITEMS, SPANS = pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
#: The alphabets have 8,192 characters each, so far more words than a worker should hold.
MOST_WORDS = 10_000_000

_held: dict[str, Windows] = worker_cache()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Windows:
    """Automaton over one block of items, as (id, words).

    A word is two characters, of two alphabets that don't overlap, so that no
    match begins within a word and no state has more than some hundred followers.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        known = dict.fromkeys(w for _, words in items for w in words)
        base = math.isqrt(len(known)) + 1
        self.letters = {w: chr(FIRST + n // base) + chr(SECOND + n % base) for n, w in enumerate(known)}
        owners: dict[str, set[str]] = {}
        for item, words in items:
            s = "".join(map(self.letters.__getitem__, words))
            for i in range(0, max(1, len(s) - 2 * size + 1), 2):
                owners.setdefault(s[i : i + 2 * size], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for s, ids in owners.items():
            self.automaton.add_word(s, (len(s) // 2, tuple(sorted(ids))))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges [first, end) that are hit, and the items found."""
        if self.empty or not words:
            return [], set()
        ranges: list[tuple[int, int]] = []
        ids: set[str] = set()
        for at, (n, items) in self.automaton.iter("".join(map(self.letters.get, words, repeat(OUTSIDE)))):
            ids.update(items)
            end = (at + 1) // 2
            first = end - n
            while ranges and ranges[-1][0] >= first:  # a longer window that ends here holds what came before
                ranges.pop()
            if ranges and ranges[-1][1] >= first:
                ranges[-1] = (ranges[-1][0], end)
            else:
                ranges.append((first, end))
        return ranges, ids


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character ranges of the original text for word ranges."""
    at = [m.span() for m in WORD.finditer(text)]
    return [{"first": at[a][0], "last": at[b - 1][1]} for a, b in ranges]


def _cut_items(benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """item_id, words (joined with blanks) and block of each item, or of each piece of a long one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            for item, text in zip(column(batch, "item_id").to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                starts = range(0, max(1, len(words) - window + 1), block_words - window + 1) if words else ()
                pieces = [words[i : i + block_words] for i in starts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(pieces), pa.string()), pa.array([b" ".join(p) for p in pieces], pa.binary()), pa.array([len(p) for p in pieces], pa.int64())], names=["item_id", "words", "n"])

    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    pieces = materialize(rows.mapInArrow(cut, "item_id string, words binary, n bigint").distinct(), "items")
    return running_sum(pieces, ["item_id", "words"], F.col("n"), "upto").select("item_id", "words", F.floor((F.col("upto") - 1) / block_words).alias("block"))


def _scanner(key: str, sent: Broadcast) -> Windows:
    """The worker's automaton; another block's is let go."""
    only(_held)
    if key not in _held:
        _held.clear()
        items, window = sent.value
        _held[key] = Windows([(item, bytes(words).split()) for item, words in items], window)
    return _held[key]


def _merged(ranges: list[tuple[int, int]], words: list[bytes], ids: set[str] | list[str], text: bytes) -> tuple[int, int, list[str], list[dict[str, int]]]:
    return len(words), sum(b - a for a, b in ranges), sorted(ids), spans_of(text.decode("utf-8", "replace"), ranges) if ranges else []


def _results(batch: pa.RecordBatch, keep: tuple[str, ...], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    made = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), ITEMS, SPANS), strict=True)]
    return pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), *made], names=[*(f"c{i}" for i in range(len(keep))), "n_words", "n_hit", "item_ids", "spans"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 100_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs: text and the columns to keep. Words, hit words, items found and hit character spans for each row."""
    if not 2 * window <= block_words <= MOST_WORDS:
        raise ValueError(f"block_words must be from {2 * window} to {MOST_WORDS}")
    spark = docs.sparkSession
    items = materialize(_cut_items(benchmark, window, block_words), "blocks")
    blocks = [r["block"] for r in items.select("block").distinct().orderBy("block").collect()] or [0]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(keep)), FOUND])
    named = {f"c{i}": c for i, c in enumerate(keep)}

    def send(block: int) -> tuple[str, Broadcast]:
        # two blocks' words at most, as a piece that begins in a block may end in the next
        rows = items.filter(F.col("block") == block).select("item_id", "words").toArrow()
        return uuid.uuid4().hex, spark.sparkContext.broadcast((list(zip(rows["item_id"].to_pylist(), rows["words"].to_pylist(), strict=True)), window))

    if len(blocks) == 1:
        key, sent = send(blocks[0])

        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(key, sent)
            for batch in in_parts(batches):
                rows = []
                for text in texts_of(batch):
                    words = words_of(text)
                    rows.append(_merged(*_scan(scanner, words), text))
                yield _results(batch, keep, rows)

        return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema).withColumnsRenamed(named)

    numbered = materialize(docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), "text").withColumn("uid", F.monotonically_increasing_id()), "scanned")
    hits = None
    for block in blocks:
        key, sent = send(block)

        @released
        def find(batches: Iterator[pa.RecordBatch], key=key, sent=sent) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(key, sent)
            for batch in in_parts(batches):
                found = [(uid, sorted(ids), [{"first": a, "last": b} for a, b in ranges]) for uid, text in zip(column(batch, "uid").to_pylist(), texts_of(batch), strict=True) for ranges, ids in [scanner.scan(words_of(text))] if ids]
                uids, names, ranges = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(names, ITEMS), pa.array(ranges, SPANS)], names=["uid", "item_ids", "ranges"])

        one = materialize(numbered.select("uid", "text").mapInArrow(find, HITS), "hits")
        hits = one if hits is None else hits.union(one)
        sent.unpersist()
    # a row for each block at most
    all_hits = hits.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("ids"), F.flatten(F.collect_list("ranges")).alias("ranges"))

    @released
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = []
            for text, ids, ranges in zip(texts_of(batch), column(batch, "ids").to_pylist(), column(batch, "ranges").to_pylist(), strict=True):
                rows.append(_merged(_union([(r["first"], r["last"]) for r in ranges or []]), words_of(text), ids or [], text))
            yield _results(batch, tuple(named), rows)

    met = numbered.join(materialize(all_hits, "all-hits"), "uid", "left").select(*named, "text", "ids", "ranges")
    return met.mapInArrow(meet, schema).withColumnsRenamed(named)


def _scan(scanner: Windows, words: list[bytes]) -> tuple[list[tuple[int, int]], list[bytes], set[str]]:
    ranges, ids = scanner.scan(words)
    return ranges, words, ids


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
