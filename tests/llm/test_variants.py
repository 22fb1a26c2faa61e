"""Spelling variants against a plain search, at every size of shards and of crowded segments."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import queries, variants

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, word string, n long"


def plain_words(rows, least=6, uses=5):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= uses}


def plain_near(words):
    cut = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cut[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for short, several in cut.items():
        for w in several:
            near[w] |= {v for v in several if v != w and sum(a != b for a, b in zip(v, w, strict=True)) == 1}
            if short in words:
                near[w].add(short)
                near[short].add(w)
    return {w: s for w, s in near.items() if s}


def plain(rows):
    words = plain_words(rows)
    near, forms = plain_near(words), {}
    for w, s in near.items():
        best = min(s, key=lambda v: (-words[v], v))
        if words[best] >= 5 * words[w]:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {(w, forms.get(w), root(w), n, len(near.get(w, ())), words[forms[w]] if w in forms else None) for w, n in words.items()}


def test_all_words_of_the_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = [tuple(r) for r in queries.op11_spelling_variants(spark, data).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows) and any(r[1] for r in found)


@pytest.mark.parametrize(("shard_words", "hot"), [(20_000, 20_000), (50, 1), (300, 4)])
def test_crowded_segments_lose_no_link(spark, shard_words, hot):
    """Many words of one beginning or one end, in all lengths, with letters that repeat."""
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 9))) for _ in range(400)} | {"common" + "".join(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(200)} | {"".join(rng.choices("abc", k=3)) + "ending" for _ in range(30)} | {"x" * n for n in (1, 2, 7, 8, 40, 41, 42, 300, 301)}
    table = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    found = [tuple(sorted((r.a, r.b))) for r in variants.near_words(table, shard_words=shard_words, hot=hot).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {tuple(sorted((w, v))) for w, s in plain_near(dict.fromkeys(words, 1)).items() for v in s}


def test_one_edit():
    rows = lambda *w: np.array([list(x.encode("latin-1")) for x in w], np.uint8)
    assert variants.one_edit(rows("abc", "abc", "abc"), rows("abd", "abc", "bca")).tolist() == [True, False, False]
    assert variants.one_edit(rows("abc", "abc", "abc", "aab"), rows("abcd", "xabc", "abdd", "aaab")).tolist() == [True, True, False, True]


def test_forms_are_followed_to_the_last(spark):
    counts = {"wanderer": 700, "wandere": 130, "wander": 25, "wandex": 5, "lonely": 5}
    rows = [(i, " ".join([w.upper()] * n), "q", i) for i, (w, n) in enumerate(counts.items())]
    found = {r.word: r for r in variants.spelling_variants(spark.createDataFrame(rows, DOCS)).collect()}
    assert {w: (r.form, r.root) for w, r in found.items()} == {w: (f, t) for w, f, t, *_ in plain([r[:2] for r in rows])}
    assert found["wandex"].root == "wanderer" and found["lonely"].root == "lonely" and found["lonely"].n_near == 0


def test_edges(spark):
    """Nulls, empty and long texts, ties, repeated rows, no rows, columns called like a result."""
    rows = [(1, "garden gardens " * 6, "q", 1), (1, "garden gardens " * 6, "q", 1), (None, "gardex " * 9, None, None), (2, None, "q", 2), (3, "", "q", 3), (4, "y" * 100_000, "q", 4), (5, ("y" * 100_000 + " ") * 5, "q", 5), (6, "×÷Ààabc " * 7 + "中" * 9, "q", 6)]
    docs = spark.createDataFrame(rows, DOCS)
    found = [tuple(r) for r in variants.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert set(found) == plain([r[:2] for r in rows]) and len(found) == len(set(found))
    assert variants.spelling_variants(docs.limit(0)).count() == 0
    assert variants.spelling_variants(docs.filter("text is null")).count() == 0
