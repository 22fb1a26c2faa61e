"""The analysis of a package of documents, from exact copies to a judgement of its value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import duplicates, evidence, inventory, retrieval, topics, value
from ..storage import materialize


@dataclass
class Analysis:
    """Named tables; each is lazy but for those that several others read, which are written once."""

    projection: DataFrame
    units: DataFrame
    topics: DataFrame
    clusters: DataFrame
    assignment: DataFrame
    roles: DataFrame
    coverage: DataFrame
    value: DataFrame
    directions: DataFrame


def analyze(docs: DataFrame, states: DataFrame) -> Analysis:
    """docs: path, name, size, sha256, modified_at, text. states: path, parsed, failed, complete, sampled."""
    projection = duplicates.canonical_projection(docs.select("path", "sha256", "size", "modified_at", F.length("text").cast("long").alias("chars")))
    canonical = materialize(duplicates.canonical_documents(docs), "canonical")
    units = materialize(evidence.corpus(evidence.evidence_units(canonical)), "units")
    wide = materialize(topics.content_topics(canonical, 12), "topics")
    clusters = materialize(topics.topic_clusters(wide.filter("rank < 5"), wide.filter("rank < 10")), "clusters")
    files = inventory.with_names(docs.select("path", "size"))
    coverage = inventory.coverage(files, states, inventory.folder_scopes(files))
    root = materialize(coverage.filter("scope = '.'"), "root")
    first = units.groupBy("path").agg(F.min_by("evidence_id", "seq").alias("evidence_id"))
    found = wide.filter("rank < 5").join(F.broadcast(clusters.select("cluster_id", "topic")), "topic").join(first, "path").select("cluster_id", "evidence_id", F.col("path").alias("source"))
    facts = root.first()
    ratio = facts["parsed_file_ratio"] if facts else 0.0
    return Analysis(
        projection=projection,
        units=units,
        topics=wide,
        clusters=clusters,
        assignment=topics.assign_topics(wide.filter("rank < 10"), canonical.select("path")),
        roles=topics.document_roles(canonical),
        coverage=coverage,
        value=value.value_judgement(projection.select("role", "chars"), root, clusters, units.select("evidence_id")),
        directions=value.directions(clusters.select("cluster_id", F.col("label").alias("title"), "members"), found, facts["parsed_files"] if facts else 0, ratio),
    )


def refreshed(docs: DataFrame, states: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and states after some documents were parsed in whole; ``analyze`` then derives copies, coverage and value anew.

    parsed: columns of docs. They replace the rows of their paths.
    """
    paths = parsed.select("path").distinct()
    now = paths.select("path", F.lit(True).alias("parsed"), F.lit(False).alias("failed"), F.lit(True).alias("complete"), F.lit(False).alias("sampled"))
    return docs.join(paths, "path", "left_anti").unionByName(parsed), states.join(paths, "path", "left_anti").unionByName(now)


def report_sections(analysis: Analysis) -> DataFrame:
    """The report as rows: section, place, title, body."""
    v = analysis.value.select(F.lit("value").alias("section"), F.lit(1).alias("place"), F.col("research_level").alias("title"), F.format_string("research %.1f, usability %.1f, richness %.1f", "research_score", "usability", "richness").alias("body"))
    c = analysis.coverage.filter("scope = '.'").select(F.lit("coverage").alias("section"), F.lit(1).alias("place"), F.col("coverage_level").alias("title"), F.format_string("%d of %d files", "parsed_files", "inventory_files").alias("body"))
    t = analysis.clusters.select(F.lit("topics").alias("section"), F.substring("cluster_id", 7, 4).cast("int").alias("place"), F.col("label").alias("title"), F.format_string("%d documents", "members").alias("body"))
    d = analysis.directions.withColumn("place", F.rank().over(W.orderBy(F.desc("score"), "title"))).select(F.lit("directions").alias("section"), "place", "title", F.format_string("%.1f, %d units of %d sources", "score", "evidence_count", "sources").alias("body"))
    return v.unionByName(c).unionByName(t).unionByName(d)


def ask(units: DataFrame, question: str, scope: str = ".", top_k: int = 10) -> DataFrame:
    """A search for one question, with a verdict on each unit as its support."""
    spark = units.sparkSession
    asked = spark.createDataFrame([(1, question)], "query_id long, query string")
    found = retrieval.retrieve(units, asked, scope=scope, top_k=top_k)
    met = found.join(units.select("path", "evidence_id", "page", "text"), ["path", "evidence_id"])
    return met.withColumn("verdict", evidence.verdict(F.lit(question), F.col("text"))).select("rank", "path", "evidence_id", "page", "score", "verdict.status", "text")
