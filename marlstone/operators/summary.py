"""Summaries: folders, the package as a whole, categories of a report, names of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import QUANTITY, factual, human_size, let
from .inventory import first_rows

# Words too general to name a cluster.
GENERAL_WORDS = ["security", "software", "system", "systems", "hardware", "data", "paper", "abstract", "introduction", "using", "based"]


def ranked_topics(scopes: DataFrame, topics: DataFrame, limit: int) -> DataFrame:
    """scope, topics: the topics of most documents of each scope (scope, path), joined with |; ties by name."""
    counted = scopes.join(topics.select("path", "topic"), "path").groupBy("scope", "topic").agg(F.count("*").alias("n"))
    top = first_rows(counted, ["scope"], [F.desc("n"), F.col("topic")], limit)
    return top.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "topic"))), lambda x: x["topic"]), "|").alias("topics"))  # ``limit`` of each scope


def folder_summaries(docs: DataFrame, scopes: DataFrame, topics: DataFrame) -> DataFrame:
    """docs: path, size, chars. scopes: scope, path. One row for each folder: files, size, eight topics, three longest texts."""
    own = scopes.join(docs.select("path", "size", "chars"), "path")
    totals = own.groupBy("scope").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("chars").alias("chars"))
    longest = first_rows(own.select("scope", "path", "size", "chars"), ["scope"], [F.desc("chars"), F.desc("size"), F.col("path")], 3)
    shown = longest.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("chars")).alias("a"), (-F.col("size")).alias("b"), "path"))), lambda x: x["path"]), "|").alias("representatives"))  # three
    out = totals.join(shown, "scope").join(ranked_topics(scopes, topics, 8), "scope", "left")
    return out.select("scope", "files", "bytes", human_size(F.col("bytes")).alias("size_human"), "chars", "representatives", F.coalesce("topics", F.lit("")).alias("topics"))


def file_summaries(docs: DataFrame, units: DataFrame, topics: DataFrame) -> DataFrame:
    """docs: path, name, extension, size, chars, complete, parser, canonical_path. units: eligible ones. topics: path, rank, topic.

    path, title, summary, topics (eight), evidence_ids (the first three), deep:
    whether a closer look is worth it. A document without units or topics has
    empty lists; copies say whose copies they are.
    """
    three = first_rows(units.select("path", "seq", "evidence_id", "text"), ["path"], [F.col("seq")], 3)
    shown = three.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence_id"))), lambda x: x["evidence_id"]), "|").alias("evidence_ids"), F.min_by("text", "seq").alias("clue"))  # three
    eight = topics.filter("rank < 8").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"]), "|").alias("topics"))  # eight
    said = F.concat(
        F.coalesce(F.nullif("extension", F.lit("")), F.lit("untyped")), F.lit(" file, "), human_size(F.col("size")), F.lit(", read as "), F.coalesce("parser", F.lit("unknown")), F.lit("."),
        F.when(F.col("clue").isNotNull(), F.concat(F.lit(" It says: "), F.substring("clue", 1, 260))).otherwise(""),
        F.when(F.col("canonical_path") != F.col("path"), F.concat(F.lit(" A copy of "), F.col("canonical_path"), F.lit("."))).otherwise(""),
    )
    deep = F.col("evidence_ids").isNotNull() & (~F.coalesce("complete", F.lit(True)) | (F.col("chars") >= 8000))
    out = docs.join(shown, "path", "left").join(eight, "path", "left")
    return out.select("path", F.regexp_replace("name", r"(?<=.)\.[^.]*$", "").alias("title"), said.alias("summary"), F.coalesce("topics", F.lit("")).alias("topics"), F.coalesce("evidence_ids", F.lit("")).alias("evidence_ids"), deep.alias("deep"))


ITEM = "evidence_id string, evidence_type string, verification_status string, source_path string, page int, section string"
CONCLUSION = f"statement string, conclusion string, analysis_question string, question string, question_value string, answer string, confidence string, type string, verification_status string, evidence array<struct<{ITEM.replace(' string', ':string').replace(' int', ':int')}>>"
#: What a stored summary can hold; older ones lack some of it.
PAYLOAD = f"schema_version int, summary string, core_summary string, topics array<string>, evidence array<struct<{ITEM.replace(' string', ':string').replace(' int', ':int')}>>, evidence_chain array<struct<{ITEM.replace(' string', ':string').replace(' int', ':int')}>>, conclusion_evidence array<struct<{CONCLUSION.replace(' string', ':string').replace(' array<', ':array<')}>>"


def stored_summaries(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Summaries as they were stored (JSON text) with the defaults that today's readers need.

    ``summary`` and ``core_summary`` stand in for each other, as do ``evidence`` and
    ``evidence_chain``; missing topics are an empty list. A conclusion without a
    question, an answer or a confidence gets them; its evidence is direct, or an
    inference if the conclusion is one, and has where it is found; one without
    evidence awaits it. A text that is no object has a null version.
    """
    given = rows.withColumn("__p", F.from_json(F.col(payload), PAYLOAD)).withColumn("__object", F.rtrim(F.ltrim(F.col(payload))).startswith("{"))
    p = lambda name: F.col(f"__p.{name}")
    either = lambda a, b: F.coalesce(F.nullif(p(a), F.lit("")), F.nullif(p(b), F.lit("")))

    def item(e: Column, inferred: Column) -> Column:
        kind = F.coalesce(e["evidence_type"], F.when(inferred, "inference").otherwise("direct"))
        status = F.coalesce(e["verification_status"], F.when(inferred, "to_be_verified").otherwise("traceable"))
        return F.struct(e["evidence_id"].alias("evidence_id"), kind.alias("evidence_type"), status.alias("verification_status"), F.struct(e["source_path"].alias("source_path"), e["page"].alias("page"), e["section"].alias("section")).alias("location"))

    def conclusion(c: Column) -> Column:
        inferred = F.lower(F.coalesce(c["type"], F.lit(""))).isin("推论", "inference")
        statement = F.coalesce(c["statement"], F.nullif(c["conclusion"], F.lit("")), F.lit("conclusion"))
        evidence = F.transform(F.coalesce(F.filter(c["evidence"], lambda e: e.isNotNull()), F.array().cast(f"array<struct<{ITEM.replace(' string', ':string').replace(' int', ':int')}>>")), lambda e: item(e, inferred))
        return F.struct(
            statement.alias("statement"), F.coalesce(c["analysis_question"], F.nullif(c["question"], F.lit("")), F.lit("which_traceable_judgements")).alias("analysis_question"), F.coalesce(c["question_value"], F.lit("worth_of_further_analysis")).alias("question_value"),
            F.coalesce(c["answer"], statement).alias("answer"), F.coalesce(c["confidence"], F.lit("to_be_verified")).alias("confidence"), F.when(F.size(evidence) == 0, "evidence_missing").otherwise(c["verification_status"]).alias("verification_status"), evidence.alias("evidence"),
        )

    none = F.array().cast("array<string>")
    out = given.withColumns({
        "schema_version": F.when(F.col("__object"), F.coalesce(p("schema_version"), F.lit(1))), "summary": either("summary", "core_summary"), "core_summary": either("core_summary", "summary"), "topics": F.when(F.col("__object"), F.coalesce(p("topics"), none)),
        "evidence": F.coalesce(p("evidence"), p("evidence_chain")), "evidence_chain": F.coalesce(p("evidence_chain"), p("evidence")),
        "conclusion_evidence": F.transform(F.filter(p("conclusion_evidence"), lambda c: c.isNotNull()), conclusion),
    })
    return out.drop("__p", "__object")


def valid_summaries(summaries: DataFrame) -> DataFrame:
    """Those of a version that reports can read."""
    return summaries.filter(F.col("schema_version").isin(3, 4))


def statistics(projection: DataFrame, roles: DataFrame, units: DataFrame, states: DataFrame) -> DataFrame:
    """name, value: counts over the package, and documents by role."""
    docs = projection.agg(F.count("*").alias("documents"), F.count_if(F.col("role") == "canonical").alias("canonical_documents"), F.count_if(F.col("role") != "canonical").alias("duplicate_aliases"), F.coalesce(F.sum("chars"), F.lit(0)).alias("characters"))
    good = units.agg(F.count("*").alias("evidence_units"), F.count_if(F.col("quality.eligible")).alias("eligible_units"))
    parsed = states.agg(F.count_if(F.coalesce("parsed", F.lit(False))).alias("parsed_files"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failed_files"))
    long = [df.unpivot([], df.columns, "name", "value") for df in (docs, good, parsed)]
    by_role = roles.groupBy("role").agg(F.count("*").alias("value")).select(F.concat(F.lit("role:"), F.col("role")).alias("name"), "value")
    return long[0].unionByName(long[1]).unionByName(long[2]).unionByName(by_role)


def unparsed(files: DataFrame, states: DataFrame) -> DataFrame:
    """Files that no parser has finished, by type, with their bytes."""
    done = states.filter("parsed").select("path")
    return files.join(done, "path", "left_anti").groupBy("extension").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def categories(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Report categories. members: topic, path; docs: path, size, name. Those of a single root category hold what has no topic."""
    rest = docs.select("path").join(members.select("path").distinct(), "path", "left_anti").select(F.lit("(none)").alias("topic"), "path")
    placed = members.select("topic", "path").unionByName(rest)
    return placed.join(docs, "path").groupBy(F.col("topic").alias("category")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("path").alias("first_path"))


def cluster_names(members: DataFrame, topics: DataFrame) -> DataFrame:
    """members: cluster, path. cluster, name: its three most frequent words that say something; equal names get a number."""
    counted = members.join(topics.filter(~F.col("topic").isin(GENERAL_WORDS)).select("path", "topic"), "path").groupBy("cluster", "topic").agg(F.count("*").alias("n"))
    three = first_rows(counted, ["cluster"], [F.desc("n"), F.col("topic")], 3)
    named = three.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "topic"))), lambda x: x["topic"]), " / ").alias("name"))
    every = members.select("cluster").distinct().join(named, "cluster", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("topic "), F.col("cluster").cast("string"))))
    again = F.row_number().over(W.partitionBy("name").orderBy("cluster"))
    return every.withColumn("name", F.when(again > 1, F.concat("name", F.lit(" ("), again.cast("string"), F.lit(")"))).otherwise(F.col("name")))


def support_label(text: Column, terms: Column, semantic: Column | None = None) -> Column:
    """Why a unit is shown: it has a term, its meaning is close, it has figures, or it stands for the rest."""
    held = let(F.lower(text), lambda low: F.exists(terms, lambda t: F.contains(low, t)))
    close = (semantic >= 0.55) if semantic is not None else F.lit(False)
    return F.when(held, "literal").when(close, "semantic").when(text.rlike(QUANTITY), "numeric").when(factual(text), "factual").otherwise("representative")
