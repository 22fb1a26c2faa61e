"""The pipeline's stages by themselves, at their edges, and the whole against plain versions of its stages."""

from __future__ import annotations

import re

import corpus_pipeline as p
from pyspark.sql import functions as F

from marlstone.llm import linededup, perplexity
from tests.llm.test_brute import linked_components

COLUMNS = set(p.COLUMNS)


def test_stages_hand_on_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumns({"n_hit": F.lit(1), "kept": F.lit("x"), "clean_text": F.lit("y")})
    docs = docs.union(spark.createDataFrame([(None, None, None, None, None, 1, "x", "y"), (-5, "", "en", "s", 0, 1, "x", "y")], docs.schema))
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert set(docs.columns) == COLUMNS, name
        assert docs.count() > 0
    assert p.STAGES[-1][1](spark, docs, data).count() == docs.count()


def test_stages_take_empty_tables(spark, data):
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, data).count() == 0, name


def test_run_is_the_stages_in_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = {r.doc_id for r in perplexity.judge_documents(docs).filter("kept").collect()}
    lines = {r.doc_id: r.clean_text for r in linededup.dedup_lines(docs.filter(F.col("doc_id").isin(list(good)))).collect()}
    texts = {k: t for k, t in lines.items() if re.search(r"[^\x20\x09-\x0D]", t)}
    texts = {k: texts[k] for k, (_, c) in linked_components(texts).items() if k == c}
    word, lower = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {i: i + 32 for i in range(65, 91)}
    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = word.findall((r.text or "").translate(lower))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}

    def dirty(t):
        w = word.findall(t.translate(lower))
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    left = {k for k, t in texts.items() if not dirty(t)}
    out = {r.doc_id: r for r in p.run(spark, data).collect()}
    assert out.keys() == left
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(p.tokenizer_file("word_bpe_49k.json"))
    assert all(out[k].token_ids == library.encode(texts[k], add_special_tokens=False).ids for k in left)
