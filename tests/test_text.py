"""Tokens, cells and vectors as expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlstone.functions import cells, text, vectors


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_search_words_count_short_chinese_runs_twice(spark):
    assert one(spark, text.search_words(F.lit("Data 数据 x 数据集 a.b-1")))[0] == ["data", "数据", "数据", "数据集", "数据", "据集", "数据集", "a.b-1"]


def test_topic_words(spark):
    assert one(spark, text.topic_words(F.lit("The CAT-9 and ab 研究 人工智能系统与机器学习")))[0] == ["cat-9", "人工智能系统与机", "器学习"]


def test_claim_terms(spark):
    terms, strong = one(spark, text.claim_terms(F.lit("如何 分析 风险 AI")), text.strong_terms(text.claim_terms(F.lit("风险 AI 港口关闭"))))
    assert terms == ["风险", "ai"] and set(strong) == {"ai", "港口关闭", "港口关", "口关闭"}


def test_white_space(spark):
    assert one(spark, text.collapse(F.lit("　 a \n\tb  ")), text.short(F.lit("a  b  c"), 3)) == ("a b", "a b")


@pytest.mark.parametrize("value,kind,number,date", [("1,234.5", "number", 1234.5, None), ("1_000", "number", 1000.0, None), ("1d", "text", None, None), ("nan", "missing", None, None), ("inf", "text", None, None), ("-", "missing", None, None), ("2024-1-5", "datetime", None, "2024-01-05T00:00:00"), ("2024/01/05 3:04:05", "datetime", None, "2024-01-05T03:04:05"), ("20240101", "number", 20240101.0, None), ("2024-13-40", "text", None, None), ("true", "text", None, None), (".5e1", "number", 5.0, None)])
def test_cells(spark, value, kind, number, date):
    assert one(spark, cells.kind(F.lit(value)), cells.number(F.lit(value)), cells.date(F.lit(value))) == (kind, number, date)


def test_vectors(spark):
    a, b, zero = (F.array(*map(F.lit, x)) for x in ((1.0, 0.0), (1.0, 1.0), (0.0, 0.0)))
    cos, none, bits = one(spark, vectors.cosine(a, b), vectors.cosine(a, zero), vectors.sign_bits(F.array(F.lit(1.0), F.lit(-1.0), F.lit(0.0))))
    assert cos == pytest.approx(2**-0.5) and none == 0 and bits == 5


def test_sizes_and_names(spark):
    assert one(spark, text.human_size(F.lit(1536)), text.human_size(F.lit(3)), text.human_size(F.lit(5 << 40))) == ("1.5 KB", "3.0 B", "5.0 TB")
