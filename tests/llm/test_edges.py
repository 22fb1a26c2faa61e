"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, cminhash, decontam, kdshard, lattice, linededup, ordinal, perplexity, urltrees, warc
from marlstone.llm.queries import RULES, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word binary, tf long, bucket long, set_id string, d long, t long, pos int, `key` string, shard int, uid long, n bigint, grade int, kept boolean, label string, h long, c long"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ROWS = [
    (1, "The cat sat on the mat and then it went home again today", "en", "s", 3),
    (2, "The cat sat on the mat and then it went home again today", "en", "s", 3),
    (2, "The cat sat on the mat and then it went home again today", "en", "s", 3),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (None, "no id here but some words that go on for a while to count", None, "s", 1),
    (5, "\n\n \t\n", "fr", "s", 4),
    (6, LONG, "de", "hot", len(LONG)),
    (7, "x" * 70_000, "zz", "hot", 70_000),
    (8, "tiny", "en", "s", 4),
    (9, "Überall größere Straßen\nÜberall größere Straßen\nlinks und rechts von hier", "de", "s", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *[None] * 16) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def held(df):
    return df.withColumn("held_out", F.col("doc_id") == 4)


def test_lattice(docs, none):
    rows = lattice.score_documents(held(docs), tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id not in (2, None)}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[6].n_tokens == 60_001
    assert all(r.score < 0 for r in rows)
    assert lattice.score_documents(held(none), tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_perplexity(docs, none):
    rows = perplexity.judge_documents(docs).collect()
    assert len(rows) == len(ROWS) and {r.doc_id: r.n_words for r in rows}[6] == 60_000
    assert {r.doc_id: r.base_failed for r in rows}[3] is True
    assert perplexity.judge_documents(none).count() == 0


def test_shards(docs, none):
    rows = kdshard.shard_documents(docs, shards=4).collect()
    assert len(rows) == len(ROWS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert kdshard.shard_documents(none, shards=4).count() == 0


def test_urls(spark):
    rows = [(1, "https://a.example.net/en/x", 1, "q"), (2, None, None, None), (3, "no scheme", 0, "z"), (4, "http://EXAMPLE.com/de/#x", 1, "q"), (4, "http://EXAMPLE.com/de/#x", 1, "q"), (5, "http://b.org/fr/" + "y" * 5000, 1, ""), (6, "://", 1, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int, host string")
    out = {r.page_id: r for r in urltrees.judge_urls(pages, RULES).collect()}
    assert (out[1].rule, out[1].verdict) == ("example.net/en/", "allow")
    assert (out[4].host, out[4].rule, out[4].verdict) == ("example.com", "example.com/de/", "block")
    assert out[5].rule == "org/fr/" and out[2].host == out[3].host == out[6].host == "" and out[2].rule is None
    assert urltrees.judge_urls(pages.limit(0), RULES).count() == 0


def test_ordinal(docs, none, spark):
    ratings = spark.createDataFrame([(1, 2), (2, 0), (2, 1), (8, 0), (9, 2), (99, 1), (None, 1), (3, None)], "doc_id long, grade int")
    rows = ordinal.grade_documents(docs, ratings).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.expected_grade <= 2 for r in rows)
    assert ordinal.grade_documents(none, ratings).count() == 0
    assert {r.kept for r in ordinal.grade_documents(docs, ratings.limit(0)).collect()} == {None}


def test_near_duplicates(docs, none):
    out = {r.doc_id: r for r in cminhash.near_duplicates(docs).collect()}
    assert out[2].component_id == 1 and not out[2].kept and out[1].kept
    assert out[3].n_shingles == out[4].n_shingles == out[5].n_shingles == 0 and out[3].component_id == 3
    assert out[8].n_shingles == 1 and out[None].component_id is None
    assert cminhash.near_duplicates(docs).count() == len(ROWS)
    assert cminhash.near_duplicates(none).count() == 0


def test_archives(spark):
    big = "<p>" + "z" * 300_000
    rows = [(1, "u", big, 0), (2, "u", big, 0), (3, None, None, 0), (4, "http://x\r\ny", "small", 1), (5, "u", "small", 1), (None, "u", big, 2), (6, "u", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk_no int")
    out = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert out[2].record_type == "response" and out[1].refers_to == out[None].refers_to == 2
    assert out[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and out[1].payload_bytes == len(big)
    assert out[4].record_type == out[5].record_type == "response" and out[3].payload_bytes == out[6].payload_bytes == 0
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_lines(docs, none):
    rows = linededup.dedup_lines(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_dropped == 0 and by[2].n_dropped == 1 and by[2].clean_text == ""
    assert by[3].n_lines == by[4].n_lines == 1 and by[5].n_lines == 4 and by[9].n_dropped == 0
    assert linededup.dedup_lines(none).count() == 0


def test_bpe(docs, none):
    rows = bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json")).collect()
    assert len(rows) == len(ROWS) and {r.doc_id: r.n_tokens for r in rows}[3] == 0
    assert bpe.encode_documents(none, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_decontamination(docs, none, spark):
    bench = spark.createDataFrame([(1, "cat sat on the mat and then it went home"), (1, "cat sat on the mat and then it went home"), (2, "tiny"), (3, None), (4, ""), (None, "links und rechts"), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string")
    out = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert out[1].n_hit == 10 and out[1].item_ids == ["1"] and out[1].spans[0].first == 4
    assert out[8].n_hit == 1 and out[6].item_ids == ["5"] and out[9].n_hit == 0 and out[3].n_words == 0
    assert decontam.decontaminate(none, bench).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(docs, bench.limit(0)).collect()} == {0}
