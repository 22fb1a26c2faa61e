"""Importance resampling against a plain version, and the merge against a plain sort."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.llm import queries, resample
from marlstone.llm.decontam import words_of

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, score string, rank int"


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5):
    """Sorted rows of (doc_id, n_features, weight, score, rank)."""
    found = [(d, *plain_features(t)) for d, t in docs]
    s, t = Counter(x % 10_000 for _, _, f in found for x in f), Counter(x % 10_000 for text in target for x in plain_features(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    rows = []
    for d, words, f in found:
        weight, h = sum(gain[x % 10_000] for x in f), int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    eligible = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = eligible[: percent * len(eligible) // 100]
    rest = Counter(rows) - Counter(drawn)
    return by_key([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in rest.elements()])


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def same(df, want):
    assert by_key([tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]) == want


def test_whole_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    same(queries.op12_importance_resample(spark, data), plain(docs, target))


@pytest.mark.parametrize(("percent", "range_rows", "block_rows"), [(5, 7, 3), (50, 1, 1), (100, 9, 4), (0, 5, 5)])
def test_ranges_and_blocks_change_nothing(spark, data, percent, range_rows, block_rows):
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(7)
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()], percent)
    same(resample.resample(docs, bench, percent=percent, range_rows=range_rows, block_rows=block_rows), want)


def test_ties_and_repeats(spark):
    """A third of all rows repeat one id, and many scores are equal."""
    rows = [(7, 30, 0, 5)] * 60 + [(k % 40, 30, 0, k % 3) for k in range(120)] + [(None, 30, 0, 5)] * 3 + [(k, 19, 0, 99) for k in range(9)]
    scored = spark.createDataFrame([(d, w, f, 0, s) for d, w, f, s in rows], "doc_id long, n_words long, n_features long, weight long, score long").repartition(5)
    for percent in (3, 34, 60, 100):
        found = resample.draw(scored, percent=percent, range_rows=10, block_rows=4).collect()
        drawn = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
        want = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: percent * 183 // 100]
        assert len(found) == len(rows) and [r["rank"] for r in drawn] == list(range(1, len(want) + 1))
        assert [(r["doc_id"], r["score"]) for r in drawn] == [(d, s) for d, _, _, s in want]


def test_features_are_checksums_of_runs():
    texts = ["", "one", "one two", "Three little words here", "", "x" * 70 + " tail of it", "a " + "y" * 65, "z" * 64 + " b " + "w" * 300 + " c d", "Straße 中文 naïve 42 " * 5, "last"]
    for group in ([t] for t in texts), (texts, texts[::-1], texts[3:5]):
        for some in group:
            found, owner = resample.features_of([words_of(t.encode()) for t in some])
            assert [sorted(found[owner == i].tolist()) for i in range(len(some))] == [sorted(plain_features(t)[1]) for t in some]


def test_tournament_merges_runs():
    rng = random.Random(5)
    for size in (0, 1, 2, 5, 33):
        blocks = sorted(sorted((rng.randrange(30), k, j) for j in range(rng.randrange(1, 8))) for k in range(size))
        assert list(resample.merged((b[0], iter(b)) for b in blocks)) == sorted(x for b in blocks for x in b)


def test_edges(spark):
    """Nulls, empty and long texts, repeated rows, no rows, an empty target, columns called like a result."""
    words = " ".join(f"word{k}" for k in range(25))
    rows = [(k, f"{words} {k}", "a", 1) for k in range(30)] + [(1, words, "a", 1), (1, words, "a", 1), (None, words, "a", 1), (98, None, "a", 1), (99, "", None, None), (97, "z" * 200_000 + " b c", "a", 1), (96, "lang äöü " * 30_000, "a", 1)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, words), (2, None), (3, "")], "item_id long, text string")
    same(resample.resample(docs, bench), plain([r[:2] for r in rows], [words, None, ""]))
    same(resample.resample(docs, bench.limit(0)), plain([r[:2] for r in rows], []))
    assert resample.resample(docs.limit(0), bench).count() == 0
    assert {r["rank"] for r in resample.resample(docs.limit(3), bench).collect()} == {None}
    assert resample.resample(docs, bench, percent=100).agg(F.max("rank").alias("m")).first()["m"] == 34
