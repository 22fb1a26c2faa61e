"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from marlstone import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["retrieval_fallback", "stored_summaries", "edit_log_replay", "tree_order", "pruned_tree", "embedding_nearest", "semantic_clusters", "folder_contexts", "context_excerpts", "evidence_catalogue", "node_clusters", "bounded_file_columns", "bounded_file_profiles", "inventory_type_counts", "directory_rollup", "exact_duplicate_groups", "canonical_projection", "export_manifest", "evidence_chunks", "evidence_quality_gate", "retrieval_bm25", "content_topics", "topic_clusters", "adaptive_topic_assignment", "document_roles", "coverage_ledger", "representative_sample", "checkpoint_reuse", "simhash_fingerprints", "near_duplicate_pairs", "column_profile_events", "column_top_values_orders", "column_histogram_events", "json_props_profile", "embedding_neighbours", "sign_bucket_clusters", "tree_edit_replay", "tree_filter", "job_queue_order", "file_summaries", "evidence_union", "evidence_resolution", "text_parts", "semantic_profiles", "directory_listing", "package_time_range", "tree_coverage", "topic_subtopics", "topic_tree", "recommended_questions"]


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, data, duck, name):
    df = core.QUERIES[name](spark, data)
    cur = duck.execute(core.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(plain(x) for x in r) for r in df.collect()) == want


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_runs_without_the_subpackage(tmp_path, data):
    """The rest imports, lists its queries and runs them when the training-data subpackage is away."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = f"""
import __spark_entry__ as e
q = e.queries()
assert "retrieval_bm25" in q and not any(k.startswith("op") or k == "pipeline" for k in q) and set(e.oracle_sql()) <= set(q)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
assert q["embedding_nearest"](spark, {data!r}).count() > 0 and q["tree_filter"](spark, {data!r}).count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
