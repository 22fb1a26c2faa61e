"""From raw documents to token ids: five stages, each written and read again before the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. All but the last return the columns of ``documents``.

Every row has a verdict of its own: rows that repeat an id are judged each, and
rows without an id are judged by their text like all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bpe import encode_documents
from marlstone.llm.cminhash import near_duplicates
from marlstone.llm.common import materialize, table
from marlstone.llm.decontam import decontaminate
from marlstone.llm.linededup import dedup_lines
from marlstone.llm.perplexity import judge_documents
from marlstone.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go, whatever other rows of their id are like."""
    return judge_documents(docs, id_columns=COLUMNS).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; documents that are left without a word go too."""
    cut = dedup_lines(docs.select("doc_id", "text", "lang", "source"))
    return cut.filter(F.col("clean_text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, one with the smallest id.

    Rows that repeat an id are a group like others if their texts are alike, and
    stay each if not. Rows without an id link others and all stay themselves.
    """
    rows = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), "rows")
    placed = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    first = placed.join(rows.filter("doc_id is not null").select("__row", "doc_id"), "__row").groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first")).select("first.__row")
    kept = rows.join(first, "__row", "left_semi").unionByName(rows.filter("doc_id is null"))
    return kept.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.filter("n_hit = 0").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return encode_documents(docs, tokenizer_file("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can't express the perplexity model nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
