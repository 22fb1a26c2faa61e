"""The analysis tree as tables, edits by people, filters by review status.

Nodes: node_id, parent_id, name, kind, position, confirmed. Members: node_id, path.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import edit_log
from .inventory import coverage, first_rows

def edit_table(spark: SparkSession, edits: list[dict[str, Any]]) -> DataFrame:
    """Edits as they come from a form (edit_id, operation, payload), in order, as a log of ``edit_log``."""

    def row(seq: int, e: dict[str, Any]) -> tuple:
        p = e.get("payload") or {}
        text = lambda name: None if p.get(name) is None else str(p[name])
        groups = [(g.get("name"), [str(x) for x in g.get("paths") or []]) for g in p.get("groups") or []]
        return seq, e.get("edit_id"), str(e.get("operation") or "").strip().lower(), text("node_id"), text("name"), bool(p.get("confirmed", True)), text("path"), text("edit_id"), [str(x) for x in p.get("node_ids") or []], groups

    return spark.createDataFrame([row(i, e) for i, e in enumerate(edits, 1)], edit_log.LOG)


def replay(nodes: DataFrame, members: DataFrame, edits: list[dict[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and members after the edits. Edits that don't fit the tree are passed over."""
    return edit_log.replayed(nodes, members, edit_table(nodes.sparkSession, edits))


def filter_files(leaves: DataFrame, status: str) -> DataFrame:
    """Leaves (node_id, path, status, confidence, confirmed) that match a review status."""
    state = F.lower(F.coalesce("status", F.lit("classified")))
    ways = {
        "all": F.lit(True),
        "low_confidence": ~state.isin("failed", "unclassified") & (F.coalesce("confidence", F.lit(0.0)) < 0.65),
        "unclassified": state.isin("unclassified", "pending"),
        "failed": state == "failed",
        "confirmed": F.coalesce("confirmed", F.lit(False)),
    }
    return leaves.filter(ways.get(status, state == status))


def filter_tree(nodes: DataFrame, leaves: DataFrame, status: str) -> DataFrame:
    """Groups that keep a file, with the number of files that they keep."""
    return filter_files(leaves, status).groupBy("node_id").agg(F.count("*").alias("files")).join(nodes, "node_id").select("node_id", "name", "files")


def find_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node of that id; of several the one that comes first."""
    return nodes.filter(F.col("node_id") == F.lit(node_id)).orderBy("position", "parent_id", "name").limit(1)


def topic_tree(parts: DataFrame, docs: DataFrame, judged: DataFrame, *, per_source: int = 2, topic_items: int = 8, part_items: int = 5, file_items: int = 3) -> DataFrame:
    """The tree of topics, their parts and the parts' files, each with the evidence below it.

    parts: topic, part, path (``topics.subtopics``). docs: path, size. judged: units
    with their quality. Evidence of a node: eligible units of its documents that
    hold the topic's or the part's name, those with both first, then by quality;
    at most ``per_source`` of a document. A group's confidence follows its number
    of documents, its id the names on its way, so that no list of paths is
    gathered. A group of files is summed up by partial aggregates; units of a
    document are cut to the best before they meet the levels above.
    """
    way, part, named = ["topic", "part", "path"], F.concat_ws("|", "topic", "part"), F.concat_ws("|", "topic", "part", "path")
    level = lambda kind, key, parent, name, most: F.struct(F.lit(kind).alias("level"), key.alias("key"), parent.alias("parent"), F.col(name).alias("name"), F.lit(most).alias("most"))
    below = F.explode(F.array(
        level("topic", F.col("topic"), F.lit(None).cast("string"), "topic", topic_items),
        level("part", part, F.col("topic"), "part", part_items),
        level("file", named, part, "path", file_items),
    )).alias("x")
    nodes = parts.select(*way).join(docs.select("path", "size"), "path").select("path", "size", below).select("path", "size", "x.*")
    nodes = nodes.groupBy("level", "key", "parent", "name").agg(F.count("*").alias("documents"), F.sum("size").alias("total_size"))
    holds = lambda c: F.contains(F.lower("text"), F.lower(c)).cast("int")
    good = judged.filter("quality.eligible").select("path", "evidence_id", "seq", "text", F.col("quality.score").alias("score"))
    met = parts.select(*way).join(good, "path").withColumn("hits", holds("topic") + holds("part")).filter("hits > 0").drop("text")
    order = [F.desc("hits"), F.desc("score"), F.col("path"), F.col("seq")]
    few = first_rows(met, way, order, per_source).select("path", "evidence_id", "seq", "score", "hits", below).select("path", "evidence_id", "seq", "score", "hits", "x.key", "x.most")
    best = first_rows(few, ["key"], order, max(topic_items, part_items, file_items))
    ranked = best.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy(*order))).filter(F.col("place") <= F.col("most"))
    chain = ranked.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))), lambda x: x["evidence_id"]), "|").alias("evidence"))
    own_id = lambda c: F.concat(F.lit("group-"), F.substring(F.sha2(F.col(c), 256), 1, 16))
    n = F.col("documents")
    return nodes.join(chain, "key", "left").select(
        own_id("key").alias("node_id"), F.coalesce(own_id("parent"), F.lit("root")).alias("parent_id"), "level", "name", "documents", "total_size",
        F.when(F.col("level") != "file", F.when(n >= 3, "high").when(n >= 2, "medium").otherwise("low")).alias("confidence"),
        F.when(F.col("evidence").isNotNull(), "supported").otherwise("insufficient").alias("evidence_status"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
    )


def tree_coverage(nodes: DataFrame, members: DataFrame, files: DataFrame, states: DataFrame) -> DataFrame:
    """node_id, kind, name and the columns of ``coverage``, for the root over all files and for each group over its members.

    A group without members has zeros, never the figures of the whole.
    """
    groups = nodes.filter("kind = 'group'").select("node_id", "kind", "name")
    root = nodes.sparkSession.createDataFrame([("root", "analysis_root", "root")], "node_id string, kind string, name string")
    scopes = members.select(F.col("node_id").alias("scope"), "path").distinct().unionByName(files.select(F.lit("root").alias("scope"), "path"))
    found = coverage(files, states, scopes).withColumnRenamed("scope", "node_id")
    out = groups.unionByName(root).join(found, "node_id", "left")
    return out.fillna(0).fillna({"complete_analysis": False, "coverage_level": "inventory_complete", "inventory_size_human": "0.0 B"})
