"""Mixing: targets against plain water filling, and the laws of dependent rounding."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from marlstone.llm import mixing, queries

DOCS = "doc_id long, text string, source string, size string, copies int"


def plain_targets(sizes, most=3):
    """sizes by source; shares by weight, sources above their limit give the excess to the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, full = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        over = [s for s in rest if (total - sum(full.values())) * weight[s] / sum(weight[t] for t in rest) > most * sizes[s]]
        if not over:
            return full | {s: (total - sum(full.values())) * weight[s] / sum(weight[t] for t in rest) for s in rest}
        full |= {s: most * sizes[s] for s in over}


def checked(docs, rows, off):
    """Laws that hold for every row and source; off: the largest miss that a source may have, as a share of its target, beside its smallest document."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted((d is None, d or 0, count(t)) for d, t, _ in docs)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += count(t)
    targets = plain_targets(sizes)
    of = defaultdict(set)
    for d, _, s in docs:
        of[d].add(s)
    taken = defaultdict(int)
    for r in rows:
        (source,) = of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= off * targets[s] + 1e-6, s


def test_whole_table(spark, data):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    first = queries.op13_pivotal_mix(spark, data).collect()
    checked(docs, first, 0.05)
    assert sorted(first) == sorted(queries.op13_pivotal_mix(spark, data).collect())


def test_reduction_tree(spark):
    """Small buckets and fan-in: several levels; a third of all rows in one source; a source that can't fill its share."""
    rng = random.Random(4)
    docs = [(k, "w " * rng.choice((1, 3, 20, 300)), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(3000)] + [(5000 + k, "few words", "zz") for k in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = [mixing.mix_sources(x, head=300, bucket_rows=20, fan_in=3).collect() for x in (df, df.repartition(9).orderBy("text"))]
    checked(docs, out[0], 0.01)
    assert sorted(out[0]) == sorted(out[1])
    of = {d: s for d, _, s in docs}
    assert all(r.taken == 3 * r.size for r in out[0] if of[r.doc_id] == "zz")


def test_expected_copies_stay(spark):
    """Over many seeds every document is taken as often as its source's share says."""
    sizes, share = [900, 400, 380, 60, 50, 40, 30, 20, 10, 5, 4, 3, 2, 1], 0.3
    taken = [0] * len(sizes)
    for seed in range(3000):
        copies, _ = mixing.round_large(sizes, share * (sum(sizes) + 8000), 8000, 3, random.Random(seed))
        taken = [a + b for a, b in zip(taken, copies, strict=True)]
    assert all(abs(n / 3000 - share) < 0.05 for n in taken)


def test_pivot_keeps_words_and_chances():
    rng = random.Random(2)
    for _ in range(300):
        a, s, b, t = rng.random(), rng.randrange(1, 50), rng.random(), rng.randrange(1, 50)
        x, y = mixing.pivot(a, s, b, t, rng.random())
        assert x * s + y * t == pytest.approx(a * s + b * t, abs=1e-6) and min(x, 1 - x, y, 1 - y) == 0 <= min(x, y) and max(x, y) <= 1
    kept = [mixing.pivot(0.3, 5, 0.6, 9, k / 20_000)[0] for k in range(20_000)]
    assert sum(kept) / len(kept) == pytest.approx(0.3, abs=1e-3)


def test_edges(spark):
    """Nulls, empty and long texts, repeated rows, no rows, columns called like a result."""
    docs = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, " \t\n", "y"), (None, "d e", None), (5, "f " * 50_000, "z"), (6, "g", "z"), (7, "h", "w")]
    df = spark.createDataFrame([(*d, "q", 5) for d in docs], DOCS)
    checked(docs, mixing.mix_sources(df).collect(), 1.0)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert {(r.taken, r.target) for r in mixing.mix_sources(df.filter("doc_id in (2, 3)")).collect()} == {(0, 0.0)}
    assert [r.taken for r in mixing.mix_sources(df.filter("doc_id = 7")).collect()] == [1]
