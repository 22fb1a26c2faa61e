"""Bounds that hold, and answers that don't change where data are cut into blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, cminhash, common, decontam, lattice, ordinal, perplexity, warc
from marlstone.llm.queries import tokenizer_file
from tests.llm.test_brute import linked_components


def test_ordinal_takes_one_row_of_a_rated_id(spark, monkeypatch):
    rows = [(i % 2, f"good words number {i}") for i in range(5000)] + [(2, "bad words"), (3, "good words")]
    ratings = spark.createDataFrame([(0, 2), (1, 0), (2, 0), (3, 2)], "doc_id long, grade int")
    seen = []
    fit = ordinal.CumulativeLink.fit.__func__
    monkeypatch.setattr(ordinal.CumulativeLink, "fit", classmethod(lambda cls, rows, *a, **k: (seen.append(len(rows)), fit(cls, rows, *a, **k))[1]))
    assert ordinal.grade_documents(spark.createDataFrame(rows, "doc_id long, text string"), ratings).count() == 5002
    assert seen == [4]
    ordinal.grade_documents(spark.createDataFrame(rows, "doc_id long, text string"), ratings, fit_features=9).count()
    assert seen[1:] in ([2], [3], [])


def test_ordinal_refuses_grades_out_of_range(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for bad in (-1, 3):
        with pytest.raises(ValueError):
            ordinal.grade_documents(docs, spark.createDataFrame([(1, 0), (2, bad)], "doc_id long, grade int"))


def test_ordinal_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(1)
    score, grades, free = rng.normal(size=40), rng.integers(0, 4, 40), np.array([-0.7, 0.2, -0.4])
    cuts = ordinal._ordered(free)
    # the plain likelihood, grade by grade
    tail = lambda s, k: 1.0 if k < 0 else 0.0 if k >= len(cuts) else 1 / (1 + np.exp(-(s - cuts[k])))
    plain = -sum(np.log(tail(s, g - 1) - tail(s, g)) for s, g in zip(score, grades, strict=True))
    loss, by_score, by_free = ordinal.link_loss(score, grades, free)
    assert loss == pytest.approx(plain)
    e = 1e-6
    for i in (0, 7, 21):
        up, down = score.copy(), score.copy()
        up[i] += e
        down[i] -= e
        assert by_score[i] == pytest.approx((ordinal.link_loss(up, grades, free)[0] - ordinal.link_loss(down, grades, free)[0]) / (2 * e), abs=1e-5)
    for i in range(3):
        up, down = free.copy(), free.copy()
        up[i] += e
        down[i] -= e
        assert by_free[i] == pytest.approx((ordinal.link_loss(score, grades, up)[0] - ordinal.link_loss(score, grades, down)[0]) / (2 * e), abs=1e-4)


def test_decontamination_of_a_very_long_item(spark):
    words = [f"q{i}" for i in range(1_200_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short one here")], "item_id long, text string")
    texts = {1: " ".join(["x", *words[599_995:600_010], "y"]), 2: "a short one here b", 3: " ".join(words[5:14]), 4: " ".join(words[-10:])}
    out = {r.doc_id: r for r in decontam.decontaminate(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench, block_words=400_000).collect()}
    assert {k: (r.n_hit, r.item_ids) for k, r in out.items()} == {1: (15, ["1"]), 2: (3, ["2"]), 3: (0, []), 4: (10, ["1"])}


def test_texts_of_one_id_belong_together(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (2, a), (3, a), (4, b), (5, c), (5, c), (6, ""), (6, c)]
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in cminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(1, 36, 1, True), (2, 36, 1, False), (2, 36, 1, False), (3, 36, 1, False), (4, 36, 1, False), (5, 36, 5, True), (5, 36, 5, True), (6, 0, 6, True), (6, 36, 5, False)]


def test_templates_with_many_small_groups(spark):
    """Texts that share most of a template, some of them in pairs and threes."""
    rng = np.random.default_rng(9)
    template = [f"t{i}" for i in range(60)]
    texts = {}
    for k in range(120):
        own = template + [f"o{k}x{j}" for j in range(int(rng.integers(8, 16)))]
        for _ in range(int(rng.integers(1, 4))):
            words = list(own)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(0, len(words)))] = f"r{rng.integers(1 << 40)}"
            texts[len(texts)] = " ".join(words)
    found = {r.doc_id: r.component_id for r in cminhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == {k: c for k, (_, c) in linked_components(texts).items()}


def test_chains_longer_than_any_number_of_rounds(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in cminhash.components(edges).collect()} == {0}


def test_frequent_words_are_bounded(spark):
    """However many words have however many uses, no more than the stated number goes to the tasks."""
    counts = spark.createDataFrame([(n,) for n in [*range(1, 300), *[100_000] * 40, *[1 << 40] * 50, *[(1 << 40) + 1] * 50, 10**7, 99_999, 1 << 62]], "n long")
    spectrum = {r["s"]: r["k"] for r in counts.groupBy(lattice._step(F.col("n")).alias("s")).agg(F.count("*").alias("k")).collect()}
    for room in (0, 1, 2, 30, 60, 99, 101, 150, 300, 1000):
        least = lattice._least_count(spectrum, room)
        assert counts.filter(lattice._step(F.col("n")) >= least).count() <= room
    ordered = [r[0] for r in counts.orderBy("n").select(lattice._step(F.col("n"))).collect()]
    assert ordered == sorted(ordered)


def test_rare_words_are_joined_with_the_same_result(spark, data):
    """All figures sent to the tasks, some of them, or none: one score."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", (F.col("doc_id") % 5 == 0).alias("held_out"))
    found = [{r["doc_id"]: (r["n_known"], r["base_score"], r["score"], r["lattice_score"]) for r in lattice.score_documents(docs, tokenizer_file("piece_bpe_32k.model"), head_words=n, rounds=1).collect()} for n in (150_000, 300, 0)]
    for other in found[1:]:
        assert found[0].keys() == other.keys() and all(other[k] == pytest.approx(v, rel=1e-9) for k, v in found[0].items())


def test_a_payload_that_differs_from_its_digest_is_no_record(spark):
    chunks = spark.createDataFrame([("a.warc.gz", 3, 7, 5, "abc", True, ok) for ok in (True, None)], "archive string, record_no long, page_id long, bytes_so_far long, sha1_so_far string, is_last boolean, digest_ok boolean").withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    assert [r.payload_digest for r in warc.checked_records(chunks).collect()] == ["abc", "abc"]
    with pytest.raises(Exception, match="record 3 of a.warc.gz"):
        warc.checked_records(chunks.withColumn("digest_ok", F.lit(False))).collect()


def test_a_worker_keeps_one_operators_things(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three"], "own": [7]})
    perplexity._arrays["part"] = perplexity.HashArrays(np.zeros(1, np.int64), np.zeros(1, np.float32))
    asked = []
    monkeypatch.setattr(common, "_trim", asked.append)
    assert len(list(cminhash.sign(iter([batch])))) == 1
    assert not perplexity._arrays and cminhash._words and cminhash._tables and asked == [0]
    assert bpe.loaded(tokenizer_file("word_bpe_49k.json")) is bpe.loaded(tokenizer_file("word_bpe_49k.json"))
    assert not cminhash._words and not cminhash._tables
    assert len(list(perplexity.count_ngrams(iter([batch])))) == 1
    assert not bpe._loaded and asked == [0, 0]


def test_a_text_that_is_handed_on_is_sent_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some plain words of text number {i} that go on for a while", "en") for i in range(40)] + [(40, None, None)], "doc_id long, text string, lang string")
    sent, scored = [], perplexity._scored
    monkeypatch.setattr(perplexity, "_scored", lambda source, *a: (sent.append([k for _, k in source.dtypes].count("string")), scored(source, *a))[1])
    plain = {r.doc_id: (r.kept, r.perplexity, r.upper_bound) for r in perplexity.judge_documents(docs).collect()}
    rows = perplexity.judge_documents(docs, id_columns=("doc_id", "text", "lang"), entries=500).collect()
    assert sent == [1, 2]
    assert {r.doc_id: r.text for r in rows} == {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.kept for r in rows} == {k: x[0] for k, x in plain.items()}
    assert all(plain[r.doc_id][1:] == pytest.approx((r.perplexity, r.upper_bound)) for r in rows)


def test_counts_are_merged():
    rng = np.random.default_rng(4)
    pairs = [(np.unique(rng.integers(-50, 50, n)), None) for n in (60, 1, 40)]
    pairs = [(k, rng.integers(1, 9, len(k))) for k, _ in pairs]
    keys, counts = perplexity._merged(pairs)
    plain = {k: sum(int(c[list(x).index(k)]) for x, c in pairs if k in x) for k in {int(v) for x, _ in pairs for v in x}}
    assert keys.tolist() == sorted(plain) and dict(zip(keys.tolist(), counts.tolist(), strict=True)) == plain


def test_new_words_are_merged_together(monkeypatch):
    """Only words of one byte or of very many have a tree of their own, and the ids are those of single trees."""
    rng = np.random.default_rng(8)
    words = {"".join(map(chr, rng.choice([97, 101, 104, 110, 115, 116, 233, 0x4E2D], int(rng.integers(1, 40))))) for _ in range(3000)} | {"a", "é", "ab", "t" * 64, "t" * 65, "th" * 200}
    own = bpe.Bpe(tokenizer_file("word_bpe_49k.json"))
    single = {w: own.merge(w) for w in words}
    alone, merge = [], own.merge
    monkeypatch.setattr(own, "merge", lambda w: (alone.append(w), merge(w))[1])
    monkeypatch.setattr(bpe, "TOGETHER", 700)
    text = " ".join(sorted(words))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == [i for w in sorted(words) for i in single[w]]
    assert {len(w.encode()) for w in alone} <= {1} | set(range(65, 500)) and len(alone) < len(words) / 4
    alone.clear()
    assert own.encode("t" * 65 + " ab") and alone == ["t" * 65]


def test_the_plain_pattern_is_the_files():
    sure = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and bpe.UNSURE.match(chr(c)) is None]
    for x in sure:
        text = f"a{x}{x}1{x}'s {x}'{x}"
        assert bpe.PLAIN.findall(text) == bpe.PATTERN.findall(text), hex(ord(x))
    assert bpe.UNSURE.search("a\x1cb") and bpe.UNSURE.search("\x1f") and not bpe.UNSURE.search("\x1b ~")
