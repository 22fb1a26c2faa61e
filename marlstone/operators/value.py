"""What a package is worth: scores from coverage, topics, evidence and profiles; directions worth a study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _percent(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 100, 1)


def value_judgement(documents: DataFrame, coverage: DataFrame, clusters: DataFrame, evidence: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """One row. documents: role, chars. coverage: the root's row. clusters: members. evidence: eligible units. quality: average_quality_score."""
    d = documents.agg(F.count_if(F.col("role") == "canonical").alias("canonical"), F.count_if(F.col("role") != "canonical").alias("aliases"), F.coalesce(F.sum(F.when(F.col("role") == "canonical", F.col("chars"))), F.lit(0)).alias("chars"))
    c = clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.max("members"), F.lit(0)).alias("largest"))
    e = evidence.agg(F.count("*").alias("evidence"))
    q = quality.select((F.col("average_quality_score") / 100).alias("structured")) if quality is not None else None
    one = d.crossJoin(c).crossJoin(e).crossJoin(coverage.select("parsed_file_ratio", "parsed_byte_ratio", "parsed_files", "failed_files", "pending_files", "complete_analysis"))  # one row each
    one = one.crossJoin(q) if q is not None else one.withColumn("structured", F.lit(None).cast("double"))
    n = F.greatest("canonical", F.lit(1)).cast("double")
    density, information = F.least(F.lit(1.0), F.col("evidence") / (n * 3)), F.least(F.lit(1.0), F.col("chars") / (n * 8000))
    concentration = F.least(F.lit(1.0), F.col("largest") / n)
    files, size = F.col("parsed_file_ratio"), F.col("parsed_byte_ratio")
    usable = F.least(files, F.when(size > 0, size).otherwise(files))
    mean = F.when(F.col("structured").isNull(), (concentration + density + information) / 3).otherwise((concentration + density + information + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("structured")))) / 4)
    out = one.withColumns({
        "enough": (F.col("canonical") >= 3) & (F.col("evidence") >= 3),
        "uniqueness": _percent(F.col("canonical") / F.greatest(F.col("canonical") + F.col("aliases"), F.lit(1))),
        "topic_concentration": _percent(concentration),
        "evidence_density": _percent(density),
        "usability": _percent(usable),
        "richness": _percent((information + density) / 2),
        "raw": _percent(mean),
    })
    score = F.when(F.col("enough"), F.col("raw")).otherwise(F.least("raw", F.lit(59.0)))
    level = F.when(~F.col("enough"), "to_confirm").when(score >= 75, "high").when((score >= 45) & ((F.col("clusters") > 0) | (F.col("evidence") > 0)), "medium_high").when(score >= 45, "medium").when((F.col("pending_files") > 0) | (F.col("parsed_files") == 0), "to_analyse").otherwise("low")
    three = lambda c, a, b: F.when(F.col(c) >= a, "high").when(F.col(c) >= b, "medium").otherwise("low")
    return out.select(
        F.col("canonical").alias("canonical_documents"), F.col("aliases").alias("duplicate_aliases"), F.col("evidence").alias("valid_evidence"),
        "uniqueness", "topic_concentration", "evidence_density", "usability", three("usability", 85, 50).alias("usability_level"), "richness", three("richness", 70, 35).alias("richness_level"),
        score.alias("research_score"), level.alias("research_level"),
        F.when((files >= 0.9) & (F.col("evidence") > 0), "high").when((files >= 0.5) | (F.col("evidence") > 0), "medium").otherwise("to_analyse").alias("level"),
        F.when((files >= 0.9) & (F.col("failed_files") == 0), "high").when(files >= 0.5, "medium").otherwise("low").alias("availability"),
    )


def directions(clusters: DataFrame, evidence: DataFrame, parsed: int, parsed_ratio: float, limit: int = 8) -> DataFrame:
    """Clusters worth a study. clusters: cluster_id, title, members. evidence: cluster_id, evidence_id, source. No evidence, no direction."""
    each = evidence.groupBy("cluster_id").agg(F.count("*").alias("evidence_count"), F.count_distinct("source").alias("sources"))
    met = clusters.join(each, "cluster_id")
    concentration = F.least(F.lit(1.0), F.col("members") / float(max(1, parsed)))
    score = F.round(100 * (0.35 * F.least(F.lit(1.0), concentration * 3) + 0.25 * F.least(F.lit(1.0), F.col("evidence_count") / 6.0) + 0.2 + 0.2 * F.lit(float(parsed_ratio))), 1)
    scored = met.withColumn("score", score)
    priority = F.when((F.col("score") >= 70) & (F.col("evidence_count") >= 3) & (F.col("sources") >= 2), "high").when(F.col("score") >= 45, "medium").otherwise("low")
    return scored.select("cluster_id", "title", "members", "evidence_count", "sources", "score", priority.alias("priority")).orderBy(F.desc("score"), "title").limit(limit)
