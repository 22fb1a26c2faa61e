"""Queries over documents, pages and benchmark questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse, long_parts, path_id, semantic_profile
from ..operators import contexts, duplicates, evidence, inventory, retrieval, similar, summary, topics, tree, value
from ..storage import materialize
from .common import CANON, DOCS, HUMAN, RANKED, SEARCH_TOKENS, SPACES, bm25_sql, chunks_sql, documents, files, questions, table, topics_sql, units

FILES = DOCS + ", files AS (SELECT path, size FROM docs UNION ALL SELECT 'pages/' || page_id || '.html', coalesce(strlen(html), 0)::BIGINT FROM pages), inv AS (SELECT path, size, regexp_extract(path, '(\\.[^.]+)$', 1) AS extension, regexp_replace(path, '/?[^/]*$', '') AS parent FROM files)"


def inventory_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.type_counts(inventory.kept(files(spark, sf_dir)))


def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.directory_rollup(files(spark, sf_dir))


def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_groups(documents(spark, sf_dir))


def canonical_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.canonical_projection(documents(spark, sf_dir)).select("path", "canonical_path", "role", "aliases")


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.export_files(documents(spark, sf_dir))


def evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence_units(documents(spark, sf_dir)).select("path", "evidence_id", "seq", F.length("text").cast("long").alias("chars"), "content_sha256")


def evidence_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = evidence.gated(evidence.evidence_units(documents(spark, sf_dir)))
    return judged.select("path", "evidence_id", "quality.eligible", "quality.reason", "quality.score")


def evidence_corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("path", "evidence_id", "seq", "content_sha256")


def retrieval_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.retrieve(units(spark, sf_dir), questions(spark, sf_dir), vectors=False)
    return found.select("query_id", "rank", "path", "evidence_id", "score")


def retrieval_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.retrieve(units(spark, sf_dir), questions(spark, sf_dir))
    return found.select("query_id", "path", "evidence_id", "bm25", "tfidf", "score")


def retrieval_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search within what an earlier one has found."""
    corpus = units(spark, sf_dir)
    first = materialize(retrieval.retrieve(corpus, questions(spark, sf_dir), top_k=50, vectors=False), "first")
    found = retrieval.retrieve(corpus, questions(spark, sf_dir), top_k=5, among=first, vectors=False)
    return found.select("query_id", "rank", "path", "evidence_id", "score")


def retrieval_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package's own topics as queries, six units each."""
    docs = duplicates.canonical_documents(documents(spark, sf_dir))
    found = materialize(topics.content_topics(docs, 10), "topics")
    asked = topics.topic_clusters(found.filter("rank < 5"), found).orderBy("cluster_id").limit(5).select(F.col("cluster_id").alias("query_id"), F.col("label").alias("query"))
    ranked = retrieval.retrieve(units(spark, sf_dir), materialize(asked, "asked"), top_k=6, vectors=False)
    return ranked.select("query_id", "rank", "path", "evidence_id", "score")


def retrieval_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a package without topics: its most frequent tokens as one query, six units."""
    corpus = units(spark, sf_dir)
    asked = materialize(retrieval.frequent_tokens(corpus), "asked")
    found = retrieval.retrieve(corpus, asked, top_k=6, vectors=False)
    return found.join(F.broadcast(asked), "query_id").select("query", "rank", "path", "evidence_id", "score")


def stored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the documents as older and newer readers have stored them, with today's defaults."""
    docs = documents(spark, sf_dir).select("doc_id", "path", F.substring("text", 1, 40).alias("head"))
    item = F.struct(F.concat(F.lit("E"), F.col("doc_id").cast("string")).alias("evidence_id"), F.col("path").alias("source_path"))
    kind, none = F.col("doc_id") % 4, F.lit(None).cast("string")  # null fields aren't written
    one = F.struct(F.lit("said").alias("conclusion"), F.lit("inference").alias("type"), F.array(item).alias("evidence"), none.alias("question"), none.alias("statement"))
    other = F.struct(none.alias("conclusion"), none.alias("type"), F.when(F.lit(False), F.array(item)).alias("evidence"), F.lit("why").alias("question"), F.lit("stated").alias("statement"))
    old = F.to_json(F.struct(F.col("head").alias("core_summary"), F.array(item).alias("evidence")))
    new = F.to_json(F.struct(F.lit(3).alias("schema_version"), F.col("head").alias("summary"), F.array(F.lit("t")).alias("topics"), F.array(item).alias("evidence_chain"), F.array(one, other).alias("conclusion_evidence")))
    rows = docs.select("path", F.when(kind == 0, old).when(kind == 1, new).when(kind == 2, F.lit("[1]")).otherwise(F.lit("{}")).alias("payload"))
    out = summary.stored_summaries(rows)
    c = F.explode_outer("conclusion_evidence")
    flat = out.select("path", "schema_version", "summary", "core_summary", F.array_join("topics", "|").alias("topics"), F.size(F.coalesce("evidence", F.array())).alias("evidence"), F.size(F.coalesce("evidence_chain", F.array())).alias("chain"), c.alias("c"))
    return flat.select("path", F.col("schema_version").cast("long").alias("schema_version"), "summary", "core_summary", "topics", F.col("evidence").cast("long").alias("evidence"), F.col("chain").cast("long").alias("chain"), "c.statement", "c.analysis_question", "c.answer", "c.confidence", "c.verification_status", F.get("c.evidence", F.lit(0))["evidence_type"].alias("evidence_type"), F.get("c.evidence", F.lit(0))["location"]["source_path"].alias("source_path"))


def content_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.content_topics(documents(spark, sf_dir), 8).withColumn("rank", F.col("rank").cast("long"))


def _wide_topics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = duplicates.canonical_documents(documents(spark, sf_dir))
    return docs, materialize(topics.content_topics(docs, 12), "topics")


def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, wide = _wide_topics(spark, sf_dir)
    return topics.topic_clusters(wide.filter("rank < 5"), wide.filter("rank < 10"))


def adaptive_topic_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, wide = _wide_topics(spark, sf_dir)
    return topics.assign_topics(wide.filter("rank < 10"), docs.select("path"))


def _tree(docs: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (topic, label) and members (topic, path) of the adaptive tree."""
    placed = topics.assign_topics(wide.filter("rank < 10"), docs.select("path"))
    members = materialize(placed.filter("memberships <> ''").select(F.explode(F.split("memberships", r"\|")).alias("topic"), "path"), "members")
    return topics.labelled(members, wide.filter("rank < 10")), members


def topic_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, wide = _wide_topics(spark, sf_dir)
    labels, members = _tree(docs, wide)
    sizes = members.groupBy("topic").agg(F.count("*").alias("n"))
    place = sizes.join(labels, "topic").select(F.col("topic").alias("node_id"), F.struct((-F.col("n")).alias("o"), F.col("topic").alias("t")).alias("position"), F.split("label", " / ").alias("terms"))
    return topics.mounts(wide, materialize(place, "groups"), members.withColumnRenamed("topic", "node_id")).select("path", "node_id", "overlap")


def topic_subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, wide = _wide_topics(spark, sf_dir)
    _, members = _tree(docs, wide)
    parts = topics.subtopics(members, wide.filter("rank < 10").select("path", "topic"))
    return parts.groupBy("topic", "part", "place").agg(F.count("*").alias("documents"), F.min("path").alias("first_path"))


def topic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics, parts and files with their evidence."""
    docs, wide = _wide_topics(spark, sf_dir)
    _, members = _tree(docs, wide)
    parts = materialize(topics.subtopics(members, wide.filter("rank < 10").select("path", "topic")), "parts")
    return tree.topic_tree(parts, docs, evidence.gated(evidence.evidence_units(docs)))


def document_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of documents, and of pages by their raw HTML."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).alias("text"))
    both = documents(spark, sf_dir).select("path", "name", "text").unionByName(pages)
    return topics.document_roles(both).select("path", "role", F.col("data_score").cast("long").alias("data_score"), F.col("research_score").cast("long").alias("research_score"))


def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a claim against the units that search finds for it."""
    corpus, asked = units(spark, sf_dir), questions(spark, sf_dir)
    found = retrieval.retrieve(corpus, asked, top_k=8, vectors=False).select("query_id", "path", "evidence_id")
    met = found.join(corpus.select("path", "evidence_id", "text"), ["path", "evidence_id"]).join(asked, "query_id")
    v = evidence.verdict(collapse(F.col("query")), F.col("text"))
    return met.withColumn("v", v).select("query_id", "path", "evidence_id", F.col("v.status").alias("support_status"), F.col("v.score").alias("support_score"), F.col("v.relation").alias("relation"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.col("query").alias("question"))
    return evidence.select(units(spark, sf_dir), asked)


def evidence_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select("question_id", "evidence_id", "path", "match", "overlap", "score", "support_status", "support_score")


def claim_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"))
    return evidence.bind_claims(claims, _selected(spark, sf_dir))


def research_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic clusters as directions; their evidence is the first eligible unit of each of their documents."""
    docs, wide = _wide_topics(spark, sf_dir)
    narrow = wide.filter("rank < 5")
    clusters = materialize(topics.topic_clusters(narrow, wide.filter("rank < 10")), "clusters")
    first = evidence.representative(evidence.evidence_units(docs)).select("path", "evidence_id")
    found = narrow.join(F.broadcast(clusters.select("cluster_id", "topic")), "topic").join(first, "path").select("cluster_id", "evidence_id", F.col("path").alias("source"))
    return value.directions(clusters.select("cluster_id", F.col("label").alias("title"), "members"), found, docs.count(), 1.0)


def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels count as parsed: good ones completely, toxic ones as a sample; empty ones have failed."""
    docs = documents(spark, sf_dir)
    return inventory.coverage(docs.select("path", "size"), _states(spark, sf_dir, docs), inventory.folder_scopes(inventory.with_names(docs.select("path", "size"))))


def _states(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    empty = F.trim("text") == ""
    parsed = F.col("quality").isNotNull() & ~empty
    return docs.join(labels, "doc_id", "left").select("path", parsed.alias("parsed"), empty.alias("failed"), (parsed & (F.col("quality") == 1)).alias("complete"), (parsed & (F.col("toxic") == 1)).alias("sampled"))


def value_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    root = inventory.coverage(docs.select("path", "size"), _states(spark, sf_dir, docs), docs.select(F.lit(".").alias("scope"), "path"))
    roles = duplicates.canonical_projection(docs).select("role", F.length("text").cast("long").alias("chars"))
    _, wide = _wide_topics(spark, sf_dir)
    good = evidence.gated(evidence.evidence_units(duplicates.canonical_documents(docs))).filter("quality.eligible").select("evidence_id")
    return value.value_judgement(roles, root, topics.topic_clusters(wide.filter("rank < 5"), wide.filter("rank < 10")), good)


def representative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.representative_sample(files(spark, sf_dir), 60).select("path")


def checkpoint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents have been done before: toxic ones were not finished, and those of low quality have changed since."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    was = F.concat_ws("|", "path", (F.col("size") + F.when(F.col("quality") == 0, 1).otherwise(0)).cast("string"), F.lit(""))
    states = docs.join(labels, "doc_id").select("path", F.when(F.col("toxic") == 1, "failed").otherwise("completed").alias("status"), was.alias("fingerprint"))
    return inventory.reuse(docs, states)


def simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.fingerprints(documents(spark, sf_dir)).select("path", "chars", F.lpad(F.conv(F.col("fingerprint").cast("string"), 10, 16), 16, "0").alias("fingerprint"))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(duplicates.canonical_documents(documents(spark, sf_dir))).select("left_path", "right_path", "distance")


def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_groups(duplicates.canonical_documents(documents(spark, sf_dir)))


def folder_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, wide = _wide_topics(spark, sf_dir)
    own = docs.select("path", "size", F.length("text").cast("long").alias("chars"))
    return summary.folder_summaries(own, inventory.folder_scopes(inventory.with_names(own)), wide.filter("rank < 5"))


def package_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    projection = duplicates.canonical_projection(docs).select("role", F.length("text").cast("long").alias("chars"))
    return summary.statistics(projection, topics.document_roles(docs), evidence.gated(evidence.evidence_units(docs)), _states(spark, sf_dir, docs))


def unparsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.unparsed(files(spark, sf_dir), _states(spark, sf_dir, documents(spark, sf_dir)))


def report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, wide = _wide_topics(spark, sf_dir)
    _, members = _tree(docs, wide)
    return summary.categories(members, docs.select("path", "size", "name"))


def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the near-duplicate groups, from their documents' words."""
    docs = duplicates.canonical_documents(documents(spark, sf_dir))
    groups = materialize(similar.similar_groups(docs), "groups").select(F.col("cluster_id").alias("cluster"), "path")
    return summary.cluster_names(groups, topics.content_topics(docs, 8))


def package_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents and pages together count as a large package."""
    return spark.createDataFrame([inventory.policy(files(spark, sf_dir))], "mode string, enabled boolean, inventory_files long, inventory_bytes long")


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty paths at even distances in the order of paths."""
    return inventory.even_sample(documents(spark, sf_dir).select("path"), "path", 60)


def alias_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the folders' groups: the canonical documents, and after them their exact copies wherever those are."""
    docs = documents(spark, sf_dir)
    members = duplicates.canonical_documents(docs).select(F.element_at(F.split("path", "/"), 1).alias("folder"), "path")
    return duplicates.with_aliases(members, docs.select("path", "sha256", "size", "modified_at"))


def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten answers of some claims each: supported only if all their claims are."""
    claims = claim_binding(spark, sf_dir)
    return evidence.answer_status(claims.select((F.col("question_id") % 10).alias("node_id"), "claim_status"))


def node_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of evidence below each folder: units, eligible units, files with evidence, mean score."""
    judged = evidence.gated(evidence.evidence_units(documents(spark, sf_dir)))
    return evidence.node_evidence(judged, inventory.folder_scopes(inventory.with_names(documents(spark, sf_dir).select("path", "size"))))


def cluster_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each topic cluster the best units of its documents: two of a document, five in all."""
    docs, wide = _wide_topics(spark, sf_dir)
    narrow = wide.filter("rank < 5")
    found = materialize(topics.topic_clusters(narrow, wide.filter("rank < 10")), "clusters")
    members = narrow.join(F.broadcast(found.select("cluster_id", "topic")), "topic").select(F.col("cluster_id").alias("node_id"), "path")
    return evidence.best_of_nodes(evidence.gated(evidence.evidence_units(docs)), members, per_source=2, limit=5)


def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    heads = duplicates.canonical_projection(docs.select("path", "name", "sha256", "size", "modified_at", F.length("text").cast("long").alias("chars")))
    good = evidence.gated(evidence.evidence_units(docs)).filter("quality.eligible")
    return summary.file_summaries(heads.withColumns({"extension": F.lit(".txt"), "complete": F.lit(True), "parser": F.lit("text")}), good, topics.content_topics(docs, 8))


def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all questions find, as one list of twelve."""
    return retrieval.merged(materialize(retrieval.retrieve(units(spark, sf_dir), questions(spark, sf_dir), vectors=False), "found"))


def evidence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unit that each document should have, looked up by its id; some documents have none."""
    wanted = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("E-"), F.substring("sha256", 1, 10), F.lit("-00001")).alias("evidence_id"))
    return evidence.resolved(wanted, units(spark, sf_dir)).select("doc_id", "evidence_id", "unit_path", F.sha2("unit_text", 256).alias("unit_sha256"))


def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in parts of 400 characters or more, twelve at most before they are cut back to newlines."""
    parts = documents(spark, sf_dir).select("doc_id", "text", F.explode(long_parts(F.col("text"), 12, 400)).alias("p"))
    return parts.select("doc_id", F.col("p.index").cast("long").alias("part"), F.col("p.start").cast("long").alias("start"), F.col("p.end").cast("long").alias("end"), F.sha2(F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")), 256).alias("part_sha256"))


def semantic_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts have no headings here; their profiles are named by their id."""
    body = documents(spark, sf_dir).select("doc_id", "path", collapse(F.col("text")).alias("body"))
    return body.select("doc_id", path_id(F.col("path")).alias("path_id"), semantic_profile(F.col("doc_id").cast("string"), F.array().cast("array<string>"), F.col("body")).alias("profile"))


def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.listing(files(spark, sf_dir))


def package_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a file that was changed when it happened."""
    return inventory.time_range(table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_at")))


def tree_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the root and of a group for each language, and of one that has no documents."""
    docs = documents(spark, sf_dir)
    members = docs.select(F.element_at(F.split("path", "/"), 1).alias("node_id"), "path")
    nodes = members.select("node_id").distinct().unionByName(spark.createDataFrame([("nobody",)], "node_id string")).select("node_id", F.lit("group").alias("kind"), F.col("node_id").alias("name"))
    return tree.tree_coverage(nodes, members, docs.select("path", "size"), _states(spark, sf_dir, docs))


def _folder_contexts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir)
    members = inventory.folder_scopes(inventory.with_names(docs.select("path", "size"))).withColumnRenamed("scope", "node_id")
    return contexts.node_contexts(members, docs.select("path", "size", F.lit(".txt").alias("extension"), "text"))


def folder_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for each folder: totals, and how much of it a context can show."""
    return _folder_contexts(spark, sf_dir)[0]


def context_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpts of each folder's context."""
    return _folder_contexts(spark, sf_dir)[1].select("node_id", "place", "path", "chars", F.sha2("excerpt", 256).alias("excerpt_sha256"))


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evidence of the folders by topic clusters: chains of five units a cluster, representatives the cluster's first five documents."""
    docs, wide = _wide_topics(spark, sf_dir)
    narrow = wide.filter("rank < 5")
    found = materialize(topics.topic_clusters(narrow, wide.filter("rank < 10")), "clusters")
    inside = materialize(narrow.join(F.broadcast(found.select("cluster_id", "topic")), "topic").select("cluster_id", "path"), "cluster-members")
    judged = materialize(evidence.gated(evidence.evidence_units(docs)).select("path", "evidence_id", "seq", "quality"), "judged")
    chains = materialize(evidence.best_of_nodes(judged, inside.withColumnRenamed("cluster_id", "node_id"), per_source=2, limit=5).withColumnRenamed("node_id", "cluster_id"), "chains")
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy("path"))
    heads = inventory.first_rows(inside, ["cluster_id"], [F.col("path")], 5).withColumn("place", place)
    members = inventory.folder_scopes(inventory.with_names(docs.select("path", "size"))).withColumnRenamed("scope", "node_id")
    clusters = found.select("cluster_id", F.substring("cluster_id", 7, 9).cast("long").alias("position"))
    return contexts.evidence_catalogue(clusters, inside, chains, heads, judged.filter("quality.eligible").select("path", F.col("seq").alias("place"), "evidence_id"), members)


def evidence_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir)[0]


def node_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir)[1]


QUERIES = {f.__name__: f for f in (
    retrieval_fallback, stored_summaries,
    folder_contexts, context_excerpts, evidence_catalogue, node_clusters,
    file_summaries, evidence_union, evidence_resolution, text_parts, semantic_profiles, directory_listing, package_time_range, tree_coverage,
    package_policy, even_sample, alias_members, answer_status, node_evidence, cluster_evidence,
    inventory_type_counts, directory_rollup, exact_duplicate_groups, canonical_projection, export_manifest, evidence_chunks, evidence_quality_gate, evidence_corpus_dedup,
    retrieval_bm25, retrieval_hybrid, retrieval_narrowed, retrieval_manifest, content_topics, topic_clusters, adaptive_topic_assignment, topic_mounts, topic_subtopics, topic_tree, document_roles,
    claim_verification, evidence_selection, claim_binding, research_directions, coverage_ledger, value_judgement, representative_sample, checkpoint_reuse,
    simhash_fingerprints, near_duplicate_pairs, near_duplicate_groups,
    folder_summaries, package_statistics, unparsed_files, report_categories, cluster_names,
)}

ASKED = "asked AS (SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark)"
CLUSTERS = """
sets AS (SELECT topic, count(*) AS members, string_agg(path, '|' ORDER BY path) AS paths, min(path) AS first_path, max(path) AS last_path FROM topics WHERE rank < 5 GROUP BY topic HAVING count(*) >= 2),
kept AS (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY paths ORDER BY topic) = 1),
top20 AS (SELECT *, row_number() OVER (ORDER BY members DESC, topic) AS place FROM kept QUALIFY place <= 20),
pairs AS (SELECT c.topic, w.topic AS word, count(*) AS n, min((w.path, w.rank)) AS first FROM top20 c JOIN topics t ON t.topic = c.topic AND t.rank < 5 JOIN topics w ON w.path = t.path AND w.rank < 10 AND w.topic <> c.topic GROUP BY 1, 2 HAVING count(*) >= 2),
two AS (SELECT topic, string_agg(word, ' / ' ORDER BY r) AS words FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, first) AS r FROM pairs) WHERE r <= 2 GROUP BY topic),
clusters AS (SELECT 'TOPIC-' || lpad(place::VARCHAR, 4, '0') AS cluster_id, topic, topic || coalesce(' / ' || words, '') AS label, members, first_path, last_path FROM top20 LEFT JOIN two USING (topic))"""
ASSIGNED = """
total AS (SELECT count(*) AS n FROM canon),
shared AS (SELECT topic, df FROM (SELECT topic, count(*) AS df FROM topics WHERE rank < 10 GROUP BY 1), total WHERE df BETWEEN 2 AND greatest(2, ceil(n * 0.85)) QUALIFY row_number() OVER (ORDER BY df DESC, topic) <= (SELECT CASE WHEN n <= 10 THEN 6 WHEN n <= 50 THEN 8 ELSE 12 END FROM total)),
cand AS (SELECT path, topic, df, rank, df / (rank + 1)::DOUBLE AS score FROM topics JOIN shared USING (topic) WHERE rank < 10),
prim AS (SELECT path, topic, score FROM cand QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, df DESC, rank, topic DESC) = 1),
near3 AS (SELECT c.path, c.topic, c.score, row_number() OVER (PARTITION BY c.path ORDER BY c.score DESC, c.topic) AS r FROM cand c JOIN prim p ON p.path = c.path WHERE c.score >= p.score * 0.55),
memb AS (SELECT path, topic, r FROM near3 WHERE r <= 3 UNION SELECT path, topic, 0 FROM prim p WHERE NOT EXISTS (SELECT 1 FROM near3 n WHERE n.path = p.path AND n.topic = p.topic AND n.r <= 3)),
sec AS (SELECT path, score FROM cand QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC) = 2),
held AS (SELECT m.* FROM memb m, total WHERE n <= 6 OR topic NOT IN (SELECT topic FROM memb GROUP BY topic HAVING count(*) = 1)),
listed AS (SELECT path, string_agg(topic, '|' ORDER BY r) AS memberships, first(topic ORDER BY r) AS one, list(topic) AS l FROM held GROUP BY path)"""
SELECTED = rf"""
terms AS (SELECT query_id AS question_id, q, list_distinct(list_filter(regexp_extract_all(lower(q), '[a-z][a-z0-9_.-]+'), lambda t: true)) AS t FROM (SELECT *, trim(regexp_replace(query, '[\t-\r\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}]+', ' ', 'g')) AS q FROM asked)),
ut AS (SELECT path, evidence_id, seq, text, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_.-]+'))) AS term FROM corpus),
shared_terms AS (SELECT question_id, path, evidence_id, seq, text, count(*) AS overlap FROM ut JOIN (SELECT question_id, unnest(t) AS term FROM terms) USING (term) GROUP BY ALL),
cand AS (SELECT *, (overlap + regexp_matches(text, '[0-9]+(\.[0-9]+)?\s*(%|％|万|亿|吨|元|天|次|例|倍|项|种)')::INT) * 10.0::DOUBLE + 2 AS score FROM shared_terms),
per AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY question_id, path ORDER BY score DESC, seq) <= 2),
chosen AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, path, seq) <= 24),
nums AS (SELECT c.*, t.q, t.t, regexp_extract_all(t.q, '[0-9]+(?:\.[0-9]+)?\s*(?:%|％|万|亿|吨|元|天|次|例|倍|项|种)?') AS a, regexp_extract_all(c.text, '[0-9]+(?:\.[0-9]+)?\s*(?:%|％|万|亿|吨|元|天|次|例|倍|项|种)?') AS b FROM chosen c JOIN terms t USING (question_id)),
picked AS (SELECT question_id, evidence_id, path, 'direct' AS match, overlap, score, seq,
  CASE WHEN len(a) > 0 AND NOT list_has_all(b, a) THEN 'insufficient' WHEN contains(q, '100%') AND NOT contains(text, '100%') THEN 'partially_supported' ELSE 'supported' END AS support_status,
  CASE WHEN len(a) > 0 AND NOT list_has_all(b, a) THEN 0.0 WHEN contains(q, '100%') AND NOT contains(text, '100%') THEN 0.3 ELSE round(least(1.0, 0.65 + 0.08 * least(8, len(list_filter(t, lambda x: contains(lower(text), x))))), 3) END::DOUBLE AS support_score FROM nums)"""
LABELLED = "lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), states AS (SELECT path, size, text, trim(text) = '' AS failed, quality IS NOT NULL AND trim(text) <> '' AS parsed, quality, toxic FROM docs LEFT JOIN lab USING (doc_id))"

NATURAL = "array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(length(regexp_replace(x, '^0+([0-9])', '\\1'))::VARCHAR, 4, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END), '')"

ORACLE_SQL = {
    "file_summaries": f"""WITH {DOCS}, {chunks_sql('docs')}, {topics_sql('docs')},
ev AS (SELECT path, string_agg(evidence_id, '|' ORDER BY seq) AS ids, arg_min(text, seq) AS clue FROM (SELECT * FROM judged WHERE reason = 'eligible' QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq) <= 3) GROUP BY path),
tp AS (SELECT path, string_agg(topic, '|' ORDER BY rank) AS topics FROM topics WHERE rank < 8 GROUP BY path),
d AS (SELECT *, first_value(path) OVER (PARTITION BY sha ORDER BY size DESC, path) AS head FROM docs)
SELECT path, doc_id::VARCHAR AS title, '.txt file, ' || {HUMAN.format(b='size')} || ', read as text.' || coalesce(' It says: ' || substr(clue, 1, 260), '') || CASE WHEN head <> path THEN ' A copy of ' || head || '.' ELSE '' END AS summary,
coalesce(topics, '') AS topics, coalesce(ids, '') AS evidence_ids, ids IS NOT NULL AND length(d.text) >= 8000 AS deep FROM d LEFT JOIN ev USING (path) LEFT JOIN tp USING (path)""",
    "evidence_union": f"""WITH {CANON}, {chunks_sql('canon')}, {ASKED}, {bm25_sql('corpus', 'asked')}, fused AS (SELECT *, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS score FROM scored), {RANKED.format(per=3)},
once AS (SELECT evidence_id, path, query_id, rank FROM ranked WHERE rank <= 8 QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY query_id, rank) = 1)
SELECT row_number() OVER (ORDER BY query_id, rank, evidence_id) AS place, query_id, path, evidence_id FROM once ORDER BY place LIMIT 12""",
    "evidence_resolution": f"""WITH {CANON}, {chunks_sql('canon')}, w AS (SELECT doc_id, 'E-' || sha[:10] || '-00001' AS evidence_id FROM docs) SELECT doc_id, evidence_id, path AS unit_path, sha256(text) AS unit_sha256 FROM w JOIN corpus USING (evidence_id)""",
    "text_parts": """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, greatest(400, ceil(length(coalesce(text, '')) / 12.0))::BIGINT AS size FROM documents),
p AS (SELECT doc_id, 0::BIGINT AS part, 0::BIGINT AS start, 0::BIGINT AS stop FROM d UNION ALL
SELECT doc_id, part + 1, stop, CASE WHEN stop + size < n AND contains(tail, chr(10)) THEN stop + floor(size * 0.75)::BIGINT + length(tail) - position(chr(10) IN reverse(tail)) ELSE least(n, stop + size) END
FROM (SELECT p.*, d.n, d.size, substr(d.text, stop + floor(size * 0.75)::BIGINT + 1, least(n, stop + size) - stop - floor(size * 0.75)::BIGINT) AS tail FROM p JOIN d USING (doc_id) WHERE stop < n))
SELECT doc_id, part, start, stop AS "end", sha256(substr(text, start + 1, stop - start)) AS part_sha256 FROM p JOIN d USING (doc_id) WHERE part > 0""",
    "semantic_profiles": f"""WITH {DOCS}, b AS (SELECT doc_id, path, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS x FROM docs)
SELECT doc_id, sha1(path)[:16] AS path_id, substr('标题：' || doc_id || CASE WHEN length(x) > 1200 THEN chr(10) || '开头：' || substr(x, 1, 520) || chr(10) || '中段：' || substr(x, length(x) // 2 - 219, 440) || chr(10) || '结尾：' || right(x, 520) WHEN x <> '' THEN chr(10) || '正文：' || x ELSE '' END, 1, 1700) AS profile FROM b""",
    "directory_listing": f"""WITH {FILES}, up AS (SELECT DISTINCT array_to_string(string_split(parent, '/')[1:k], '/') AS folder FROM (SELECT parent, unnest(range(1, len(string_split(parent, '/')) + 1)) AS k FROM inv WHERE parent <> '')),
e AS (SELECT regexp_replace(folder, '/?[^/]*$', '') AS parent, string_split(folder, '/')[-1] AS name, true AS is_folder FROM up UNION ALL SELECT parent, string_split(path, '/')[-1], false FROM inv)
SELECT CASE WHEN parent = '' THEN '.' ELSE parent END AS parent_path, name, is_folder, row_number() OVER (PARTITION BY parent ORDER BY NOT is_folder, {NATURAL}, name) AS place FROM e""",
    "package_time_range": "SELECT min(strftime(ts, '%Y-%m-%d')) AS first_day, max(strftime(ts, '%Y-%m-%d')) AS last_day, count(ts) AS dated_files FROM events",
    "tree_coverage": f"""WITH {DOCS}, {LABELLED}, sc AS (SELECT 'root' AS node_id, * FROM states UNION ALL SELECT string_split(path, '/')[1], * FROM states),
g AS (SELECT node_id, count(*) AS inventory_files, count(*) FILTER (parsed) AS parsed_files, count(*) FILTER (failed) AS failed_files, count(*) FILTER (NOT parsed AND NOT failed) AS pending_files, count(*) FILTER (parsed AND quality = 1) AS complete_text_files, count(*) FILTER (parsed AND quality <> 1) AS partial_text_files, count(*) FILTER (parsed AND toxic = 1) AS sampled_files, sum(size)::BIGINT AS inventory_bytes, coalesce(sum(size) FILTER (parsed), 0)::BIGINT AS parsed_bytes FROM sc GROUP BY node_id),
h AS (SELECT * FROM g UNION ALL SELECT 'nobody', 0, 0, 0, 0, 0, 0, 0, 0, 0)
SELECT *, CASE WHEN node_id = 'root' THEN 'analysis_root' ELSE 'group' END AS kind, node_id AS name, coalesce(round(parsed_files / nullif(inventory_files, 0), 6), 0) AS parsed_file_ratio, round(parsed_bytes / greatest(inventory_bytes, 1), 6) AS parsed_byte_ratio,
inventory_files > 0 AND pending_files + failed_files + partial_text_files = 0 AS complete_analysis,
CASE WHEN inventory_files > 0 AND pending_files + failed_files + partial_text_files = 0 THEN 'full_text_analysis' WHEN parsed_files > 0 THEN 'representative_overview' ELSE 'inventory_complete' END AS coverage_level,
{HUMAN.format(b='inventory_bytes')} AS inventory_size_human FROM h""",
    "inventory_type_counts": f"WITH {FILES} SELECT extension, count(*) AS files, sum(size)::BIGINT AS bytes, min(size) AS least_bytes, max(size) AS most_bytes FROM inv GROUP BY extension",
    "directory_rollup": f"""WITH {FILES}, up AS (SELECT path, size, extension, parent, '.' AS directory FROM inv UNION ALL
SELECT path, size, extension, parent, array_to_string(string_split(parent, '/')[1:k], '/') FROM (SELECT *, unnest(range(1, len(string_split(parent, '/')) + 1)) AS k FROM inv WHERE parent <> '')),
t AS (SELECT directory, string_agg(extension || ':' || n, '|' ORDER BY n DESC, extension) AS types FROM (SELECT directory, extension, count(*) AS n FROM up GROUP BY 1, 2) GROUP BY 1)
SELECT directory, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (directory = CASE WHEN parent = '' THEN '.' ELSE parent END) AS direct_files, any_value(types) AS types FROM up JOIN t USING (directory) GROUP BY directory""",
    "exact_duplicate_groups": f"""WITH {DOCS}, h AS (SELECT sha, min(path) AS canonical, count(*) AS m, row_number() OVER (ORDER BY sha) AS k FROM docs GROUP BY sha)
SELECT 'DUP-' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS group_id, sha AS sha256, canonical, path, m - 1 AS duplicate_count FROM h JOIN docs USING (sha) WHERE m > 1""",
    "canonical_projection": f"WITH {DOCS} SELECT path, first_value(path) OVER w AS canonical_path, CASE WHEN row_number() OVER w = 1 THEN 'canonical' ELSE 'duplicate_alias' END AS role, CASE WHEN row_number() OVER w = 1 THEN count(*) OVER (PARTITION BY sha) - 1 ELSE 0 END AS aliases FROM docs WINDOW w AS (PARTITION BY sha ORDER BY size DESC, path)",
    "export_manifest": f"WITH {DOCS} SELECT path, sha AS sha256, min(path) OVER (PARTITION BY sha) AS kept_path, path <> min(path) OVER (PARTITION BY sha) AS omitted, size FROM docs",
    "evidence_chunks": f"WITH {DOCS}, {chunks_sql('docs')} SELECT path, evidence_id, seq, length(text) AS chars, sha256(text) AS content_sha256 FROM named",
    "evidence_quality_gate": f"""WITH {DOCS}, {chunks_sql('docs')} SELECT path, evidence_id, reason = 'eligible' AS eligible, reason,
CASE reason WHEN 'too_short' THEN -80.0 WHEN 'short_without_fact' THEN -80.0 WHEN 'question' THEN -70.0 WHEN 'topic_phrase' THEN -55.0
ELSE round(least(length(bare), 360) / 18.0 + len(regexp_extract_all(bare, '[。！？；.!?;]')) * 2 + f::INT * 8 + q::INT * 5, 3) END::DOUBLE AS score FROM judged""",
    "evidence_corpus_dedup": f"WITH {CANON}, {chunks_sql('canon')} SELECT path, evidence_id, seq, sha256(text) AS content_sha256 FROM corpus",
    "retrieval_bm25": f"WITH {CANON}, {chunks_sql('canon')}, {ASKED}, {bm25_sql('corpus', 'asked')}, fused AS (SELECT *, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS score FROM scored), {RANKED.format(per=3)} SELECT query_id, rank, path, evidence_id, score FROM ranked WHERE rank <= 8",
    "retrieval_narrowed": f"""WITH {CANON}, {chunks_sql('canon')}, {ASKED}, {bm25_sql('corpus', 'asked')}, fused AS (SELECT *, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS score FROM scored), {RANKED.format(per=3)},
few AS (SELECT * FROM corpus WHERE evidence_id IN (SELECT evidence_id FROM ranked WHERE rank <= 50)), again AS (
WITH {bm25_sql('few', 'asked')}, fused AS (SELECT *, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS score FROM scored), {RANKED.format(per=3)} SELECT * FROM ranked WHERE rank <= 5)
SELECT query_id, rank, path, evidence_id, score FROM again""",
    "retrieval_manifest": f"""WITH {CANON}, {chunks_sql('canon')}, {topics_sql('canon')}, {CLUSTERS}, asked AS (SELECT cluster_id AS query_id, label AS query FROM clusters WHERE cluster_id <= 'TOPIC-0005'), {bm25_sql('corpus', 'asked')}, fused AS (SELECT *, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS score FROM scored), {RANKED.format(per=3)}
SELECT query_id, rank, path, evidence_id, score FROM ranked WHERE rank <= 6""",
    "retrieval_fallback": f"""WITH {CANON}, {chunks_sql('canon')}, freq AS (SELECT t, count(*) AS n FROM (SELECT unnest({SEARCH_TOKENS.format(text="text")}) AS t FROM corpus) WHERE length(t) BETWEEN 2 AND 16 AND t NOT IN ({", ".join(f"'{t}'" for t in retrieval.GENERAL_TOKENS)}) GROUP BY 1 ORDER BY n DESC, t LIMIT 8),
asked AS (SELECT 0 AS query_id, string_agg(t, ' ' ORDER BY n DESC, t) AS query FROM freq), {bm25_sql('corpus', 'asked')}, fused AS (SELECT *, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS score FROM scored), {RANKED.format(per=3)}
SELECT query, rank, path, evidence_id, score FROM ranked JOIN asked USING (query_id) WHERE rank <= 6""",
    "stored_summaries": f"""WITH {DOCS}, h AS (SELECT path, substr(text, 1, 40) AS head, doc_id % 4 AS k FROM docs), c AS (SELECT unnest([0, 1]) AS i)
SELECT path, CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 3 THEN 1 END AS schema_version, CASE WHEN k < 2 AND head <> '' THEN head END AS summary, CASE WHEN k < 2 AND head <> '' THEN head END AS core_summary, CASE k WHEN 1 THEN 't' WHEN 2 THEN NULL ELSE '' END AS topics, (k < 2)::BIGINT AS evidence, (k < 2)::BIGINT AS chain,
  CASE WHEN k = 1 THEN CASE i WHEN 0 THEN 'said' ELSE 'stated' END END AS statement, CASE WHEN k = 1 THEN CASE i WHEN 0 THEN 'which_traceable_judgements' ELSE 'why' END END AS analysis_question, CASE WHEN k = 1 THEN CASE i WHEN 0 THEN 'said' ELSE 'stated' END END AS answer,
  CASE WHEN k = 1 THEN 'to_be_verified' END AS confidence, CASE WHEN k = 1 AND i = 1 THEN 'evidence_missing' END AS verification_status, CASE WHEN k = 1 AND i = 0 THEN 'inference' END AS evidence_type, CASE WHEN k = 1 AND i = 0 THEN path END AS source_path
FROM h, c WHERE k = 1 OR i = 0""",
    "retrieval_hybrid": f"""WITH {CANON}, {chunks_sql('canon')}, {ASKED}, {bm25_sql('corpus', 'asked')},
gram AS (SELECT path, evidence_id, g, count(*) AS tf FROM (SELECT path, evidence_id, unnest(flatten(list_transform([2, 3, 4], lambda k: list_transform(range(1, greatest(length(text) - k + 2, 1)), lambda i: substr(lower(text), i::INT, k))))) AS g FROM corpus) GROUP BY ALL),
voc AS (SELECT g, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM gram GROUP BY g),
qg AS (SELECT query_id, g, count(*) AS tf FROM (SELECT query_id, unnest(flatten(list_transform([2, 3, 4], lambda k: list_transform(range(1, greatest(length(q) - k + 2, 1)), lambda i: substr(q, i::INT, k))))) AS g FROM (SELECT query_id, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) AS q FROM asked)) GROUP BY ALL),
dv AS (SELECT path, evidence_id, g, (1 + ln(tf)) * idf AS w FROM gram JOIN voc USING (g)), qv AS (SELECT query_id, g, (1 + ln(tf)) * idf AS w FROM qg JOIN voc USING (g)),
dn AS (SELECT path, evidence_id, sqrt(sum(w * w)) AS s FROM dv GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(w * w)) AS s FROM qv GROUP BY ALL),
dots AS (SELECT query_id, path, evidence_id, sum(dv.w * qv.w) AS d FROM dv JOIN qv USING (g) GROUP BY ALL),
vec AS (SELECT query_id, path, evidence_id, d / dn.s / qn.s AS v FROM dots JOIN dn USING (path, evidence_id) JOIN qn USING (query_id)),
vs AS (SELECT *, v / max(v) OVER (PARTITION BY query_id) AS tfidf FROM vec), bs AS (SELECT *, bm25 / max(bm25) OVER (PARTITION BY query_id) AS b FROM scored),
fused AS (SELECT query_id, path, evidence_id, round(coalesce(b, 0), 6) AS bm25, round(coalesce(tfidf, 0), 6) AS tfidf, round(0.58 * coalesce(b, 0) + 0.42 * coalesce(tfidf, 0), 6) AS score FROM bs FULL JOIN vs USING (query_id, path, evidence_id)), {RANKED.format(per=3)}
SELECT query_id, path, evidence_id, bm25, tfidf, score FROM ranked WHERE rank <= 8""",
    "content_topics": f"WITH {DOCS}, {topics_sql('docs')} SELECT path, rank, topic, n FROM topics WHERE rank < 8",
    "topic_clusters": f"WITH {CANON}, {topics_sql('canon')}, {CLUSTERS} SELECT cluster_id, topic, label, members, first_path, last_path FROM clusters",
    "adaptive_topic_assignment": f"""WITH {CANON}, {topics_sql('canon')}, {ASSIGNED}
SELECT c.path, CASE WHEN list_contains(l.l, p.topic) THEN p.topic ELSE l.one END AS primary_topic, coalesce(memberships, '') AS memberships,
CASE WHEN l.path IS NULL THEN 0.0 ELSE round(least(0.98, greatest(0.45, 0.55 + 0.35 * CASE WHEN s.score IS NULL THEN 1.0 ELSE (p.score - s.score) / greatest(1.0, p.score) END)), 3) END AS confidence,
CASE WHEN l.path IS NULL THEN 'unclassified' ELSE 'classified' END AS status
FROM canon c LEFT JOIN listed l USING (path) LEFT JOIN prim p ON p.path = c.path AND l.path IS NOT NULL LEFT JOIN sec s ON s.path = c.path""",
    "topic_mounts": f"""WITH {CANON}, {topics_sql('canon')}, {ASSIGNED},
gpairs AS (SELECT h.topic, w.topic AS word, count(*) AS n, min((w.path, w.rank)) AS first FROM held h JOIN topics w ON w.path = h.path AND w.rank < 10 AND w.topic <> h.topic GROUP BY 1, 2 HAVING count(*) >= 2),
gwords AS (SELECT topic, word FROM gpairs QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, first) <= 2 UNION ALL SELECT DISTINCT topic, topic FROM held),
sizes AS (SELECT topic, count(*) AS n FROM held GROUP BY 1),
met AS (SELECT t.path, g.topic AS node_id, count(*) AS overlap FROM topics t JOIN gwords g ON g.word = t.topic WHERE t.rank < 12 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT path, node_id, overlap FROM met m JOIN sizes s ON s.topic = m.node_id WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.path = m.path AND h.topic = m.node_id) QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, node_id) <= 2""",
    "document_roles": rf"""WITH {DOCS}, b AS (SELECT path, text FROM docs UNION ALL SELECT 'pages/' || page_id || '.html', coalesce(html, '') FROM pages),
l AS (SELECT path, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM b), m AS (SELECT *, list_filter(regexp_split_to_array(bare, '[\n\r]+'), lambda x: trim(x) <> '')[1:50] AS lines FROM l),
s AS (SELECT *, bare <> '' AND ((bare[1] IN ('{{', '[') AND (len(string_split(bare, '":')) > 2 OR len(string_split(bare, ''':')) > 2)) OR (len(lines) >= 3 AND
 coalesce(list_max(list_transform([',', chr(9), '|'], lambda d: list_max(list_transform(lines, lambda x: CASE WHEN contains(x, d) THEN len(list_filter(lines, lambda y: length(y) - length(replace(y, d, '')) = length(x) - length(replace(x, d, '')))) ELSE 0 END)))), 0) >= 3)) AS structured FROM m),
w AS (SELECT path, text, structured, list_sum(list_transform(['摘要','关键词','参考文献','研究方法','实验结果','conclusion','abstract','references','methodology'], lambda k: contains(lower(text), k)::INT)) AS research,
 list_sum(list_transform(['销售额','增长率','统计','样本量','指标','合计','平均值','dataset'], lambda k: contains(lower(text), k)::INT)) + 5 * structured::INT AS data,
 list_sum(list_transform(['交付要求','验收标准','产品定位','用户故事','环境约束','实施要求','功能要求','需求规格','招标文件'], lambda k: contains(text, k)::INT)) AS req, least(2, list_sum(list_transform(['技术方案','系统设计','实施方案','项目说明'], lambda k: contains(text, k)::INT))) AS weak FROM s)
SELECT path, CASE WHEN contains(text, '情况概览报告') THEN '派生概览材料' WHEN structured OR data >= 5 THEN '结构化数据' WHEN research >= 4 AND research >= req + weak THEN '研究文献' WHEN req >= 3 AND req + weak >= research + 2 THEN '要求与说明材料' ELSE '一般资料' END AS role, data::BIGINT AS data_score, research::BIGINT AS research_score FROM w""",
    "claim_verification": f"""WITH {CANON}, {chunks_sql('canon')}, {ASKED}, {bm25_sql('corpus', 'asked')}, fused AS (SELECT *, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS score FROM scored), {RANKED.format(per=3)},
m AS (SELECT r.query_id, r.path, r.evidence_id, c.text, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS claim FROM ranked r JOIN corpus c USING (path, evidence_id) JOIN asked USING (query_id) WHERE rank <= 8),
n AS (SELECT *, list_distinct(regexp_extract_all(lower(claim), '[a-z][a-z0-9_.-]+')) AS t, regexp_extract_all(claim, '[0-9]+(?:\\.[0-9]+)?\\s*(?:%|％|万|亿|吨|元|天|次|例|倍|项|种)?') AS a, regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?\\s*(?:%|％|万|亿|吨|元|天|次|例|倍|项|种)?') AS b FROM m),
v AS (SELECT *, len(list_filter(t, lambda x: contains(lower(text), x))) AS k FROM n)
SELECT query_id, path, evidence_id, CASE WHEN claim = '' OR (len(a) > 0 AND NOT list_has_all(b, a)) THEN 'insufficient' WHEN contains(claim, '100%') AND NOT contains(text, '100%') THEN 'partially_supported' WHEN k > 0 THEN 'supported' ELSE 'insufficient' END AS support_status,
CASE WHEN claim = '' OR (len(a) > 0 AND NOT list_has_all(b, a)) THEN 0.0 WHEN contains(claim, '100%') AND NOT contains(text, '100%') THEN 0.3 WHEN k > 0 THEN round(least(1.0, 0.65 + 0.08 * least(8, k)), 3) ELSE 0.0 END::DOUBLE AS support_score,
CASE WHEN claim = '' OR (len(a) > 0 AND NOT list_has_all(b, a)) OR (contains(claim, '100%') AND NOT contains(text, '100%')) OR k = 0 THEN NULL ELSE 'direct' END AS relation FROM v""",
    "evidence_selection": f"WITH {CANON}, {chunks_sql('canon')}, {ASKED}, {SELECTED} SELECT question_id, evidence_id, path, match, overlap, score, support_status, support_score FROM picked",
    "claim_binding": f"""WITH {CANON}, {chunks_sql('canon')}, {ASKED}, {SELECTED},
one AS (SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY question_id, path ORDER BY score DESC, seq) = 1), three AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, path) <= 3),
g AS (SELECT question_id, count(*) FILTER (support_status = 'supported') AS supported, count(*) FILTER (support_status = 'partially_supported') AS partial, max(support_score) AS best_score FROM three GROUP BY 1)
SELECT item_id AS question_id, coalesce(supported, 0) AS supported, coalesce(partial, 0) AS partial, coalesce(best_score, 0.0)::DOUBLE AS best_score, CASE WHEN supported > 0 THEN 'direct' WHEN partial > 0 THEN 'partial' ELSE 'insufficient' END AS claim_status FROM benchmark LEFT JOIN g ON g.question_id = item_id""",
    "research_directions": f"""WITH {CANON}, {chunks_sql('canon')}, {topics_sql('canon')}, {CLUSTERS}, ev AS (SELECT path, min(seq) AS s FROM judged WHERE reason = 'eligible' GROUP BY path),
g AS (SELECT cluster_id, label AS title, any_value(members) AS members, count(*) AS evidence_count, count(DISTINCT e.path) AS sources FROM clusters c JOIN topics t ON t.topic = c.topic AND t.rank < 5 JOIN ev e ON e.path = t.path GROUP BY 1, 2),
s AS (SELECT *, round(100 * (0.35 * least(1.0, 3 * least(1.0, members / (SELECT count(*) FROM canon)::DOUBLE)) + 0.25 * least(1.0, evidence_count / 6.0) + 0.4), 1) AS score FROM g)
SELECT cluster_id, title, members, evidence_count, sources, score, CASE WHEN score >= 70 AND evidence_count >= 3 AND sources >= 2 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END AS priority FROM s ORDER BY score DESC, title LIMIT 8""",
    "coverage_ledger": f"""WITH {DOCS}, {LABELLED}, sc AS (SELECT '.' AS scope, * FROM states UNION ALL SELECT array_to_string(string_split(path, '/')[1:k], '/'), path, size, text, failed, parsed, quality, toxic FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS k FROM states)),
g AS (SELECT scope, count(*) AS inventory_files, count(*) FILTER (parsed) AS parsed_files, count(*) FILTER (failed) AS failed_files, count(*) FILTER (NOT parsed AND NOT failed) AS pending_files, count(*) FILTER (parsed AND quality = 1) AS complete_text_files, count(*) FILTER (parsed AND quality <> 1) AS partial_text_files, count(*) FILTER (parsed AND toxic = 1) AS sampled_files, sum(size)::BIGINT AS inventory_bytes, coalesce(sum(size) FILTER (parsed), 0)::BIGINT AS parsed_bytes FROM sc GROUP BY scope)
SELECT *, round(parsed_files / inventory_files, 6) AS parsed_file_ratio, round(parsed_bytes / greatest(inventory_bytes, 1), 6) AS parsed_byte_ratio, pending_files + failed_files + partial_text_files = 0 AS complete_analysis,
CASE WHEN pending_files + failed_files + partial_text_files = 0 THEN 'full_text_analysis' WHEN parsed_files > 0 THEN 'representative_overview' ELSE 'inventory_complete' END AS coverage_level,
CASE WHEN inventory_bytes < 1024 THEN printf('%.1f B', inventory_bytes::DOUBLE) WHEN inventory_bytes < 1048576 THEN printf('%.1f KB', inventory_bytes / 1024.0::DOUBLE) WHEN inventory_bytes < 1073741824 THEN printf('%.1f MB', inventory_bytes / 1048576.0::DOUBLE) ELSE printf('%.1f GB', inventory_bytes / 1073741824.0::DOUBLE) END AS inventory_size_human FROM g""",
    "value_judgement": f"""WITH {CANON}, {chunks_sql('canon')}, {topics_sql('canon')}, {CLUSTERS}, {LABELLED},
r AS (SELECT (SELECT count(*) FROM canon)::DOUBLE AS n, (SELECT count(*) FROM docs)::DOUBLE AS d, (SELECT count(*) FROM judged WHERE reason = 'eligible')::DOUBLE AS e, (SELECT sum(length(text)) FROM canon)::DOUBLE AS ch, (SELECT coalesce(max(members), 0) FROM clusters)::DOUBLE AS big, (SELECT count(*) FROM clusters) AS k,
 (SELECT count(*) FILTER (parsed) / count(*) FROM states) AS fr, (SELECT coalesce(sum(size) FILTER (parsed), 0) / greatest(sum(size), 1) FROM states) AS br, (SELECT count(*) FILTER (failed) FROM states) AS failed, (SELECT count(*) FILTER (NOT parsed AND NOT failed) FROM states) AS pending, (SELECT count(*) FILTER (parsed) FROM states) AS parsed),
s AS (SELECT *, least(1, e / (n * 3)) AS dens, least(1, ch / (n * 8000)) AS info, least(1, big / n) AS conc, round(fr, 6) AS f, round(br, 6) AS b FROM r),
t AS (SELECT *, round((conc + dens + info) / 3 * 100, 1) AS raw, round(least(f, CASE WHEN b > 0 THEN b ELSE f END) * 100, 1) AS us, round((info + dens) / 2 * 100, 1) AS rich FROM s), u AS (SELECT *, CASE WHEN n >= 3 AND e >= 3 THEN raw ELSE least(raw, 59.0) END AS score FROM t)
SELECT n::BIGINT AS canonical_documents, (d - n)::BIGINT AS duplicate_aliases, e::BIGINT AS valid_evidence, round(n / d * 100, 1) AS uniqueness, round(conc * 100, 1) AS topic_concentration, round(dens * 100, 1) AS evidence_density, us AS usability, CASE WHEN us >= 85 THEN 'high' WHEN us >= 50 THEN 'medium' ELSE 'low' END AS usability_level, rich AS richness, CASE WHEN rich >= 70 THEN 'high' WHEN rich >= 35 THEN 'medium' ELSE 'low' END AS richness_level,
score AS research_score, CASE WHEN n < 3 OR e < 3 THEN 'to_confirm' WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'medium_high' WHEN pending > 0 OR parsed = 0 THEN 'to_analyse' ELSE 'low' END AS research_level, CASE WHEN f >= 0.9 AND e > 0 THEN 'high' WHEN f >= 0.5 OR e > 0 THEN 'medium' ELSE 'to_analyse' END AS level, CASE WHEN f >= 0.9 AND failed = 0 THEN 'high' WHEN f >= 0.5 THEN 'medium' ELSE 'low' END AS availability FROM u""",
    "representative_sample": f"""WITH {FILES}, f AS (SELECT *, extension = '.txt' AND size < 5242880 AS dense FROM inv),
a AS (SELECT path, 0 AS st, row_number() OVER (ORDER BY size, path) AS r FROM f WHERE dense QUALIFY r <= 21),
x AS (SELECT extension, min(path) AS lo, max(path) AS hi, count(*) AS n FROM f GROUP BY 1), b AS (SELECT lo AS path, 1 AS st, 2 * row_number() OVER (ORDER BY n DESC, extension) AS r FROM x UNION ALL SELECT hi, 1, 2 * row_number() OVER (ORDER BY n DESC, extension) + 1 FROM x),
c AS (SELECT path, 2 AS st, row_number() OVER (ORDER BY NOT dense, path) AS r FROM f), u AS (SELECT path, min((st, r)) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1)
SELECT path FROM u ORDER BY k LIMIT 60""",
    "checkpoint_reuse": f"""WITH {DOCS}, {LABELLED} SELECT path, CASE WHEN toxic = 0 AND quality <> 0 THEN 'reuse' ELSE 'parse' END AS action, CASE WHEN quality IS NULL AND toxic IS NULL THEN 'new' WHEN toxic = 1 THEN 'unfinished' WHEN quality = 0 THEN 'changed' ELSE 'unchanged' END AS reason FROM docs LEFT JOIN lab USING (doc_id)""",
    "simhash_fingerprints": f"""WITH {DOCS}, {topics_sql('docs')}, votes AS (SELECT path, ('0x' || substr(md5(topic), 1, 16))::UBIGINT AS h, least(6, 1 + floor(log2(n + 1)))::INT AS w FROM topics),
bits AS (SELECT path, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN w ELSE -w END) AS s FROM votes, (SELECT unnest(range(0, 64))::UBIGINT AS b) GROUP BY ALL),
p AS (SELECT path, bit_or(CASE WHEN s >= 0 THEN 1::UBIGINT << b ELSE 0::UBIGINT END) AS v FROM bits GROUP BY path)
SELECT path, length(text) AS chars, lpad(upper(to_hex(v)), 16, '0') AS fingerprint FROM docs LEFT JOIN p USING (path)""",
}
PRINTS = ORACLE_SQL["simhash_fingerprints"].split("SELECT path, length(text) AS chars")[0].replace(DOCS, CANON).replace("FROM docs)", "FROM canon)")
SIMILAR = f"""{PRINTS}, fp AS (SELECT path, length(text) AS chars, v, text FROM canon JOIN p USING (path) WHERE length(trim(text)) >= 120),
cls AS (SELECT *, min(path) OVER (PARTITION BY v, chars) AS head FROM fp), one AS (SELECT * FROM cls WHERE path = head),
fe AS (SELECT path, topic FROM topics JOIN one USING (path)),
cand AS (SELECT a.path AS l, b.path AS r FROM one a JOIN one b ON a.path < b.path AND bit_count(xor(a.v, b.v)) <= 14),
size_of AS (SELECT path, count(*) AS k FROM fe GROUP BY 1), c2 AS (SELECT l, r, bit_count(xor(a.v, b.v))::BIGINT AS distance, least(a.chars, b.chars) / greatest(a.chars, b.chars) AS ratio FROM cand JOIN one a ON a.path = l JOIN one b ON b.path = r),
c3 AS (SELECT * FROM c2 WHERE (ratio >= 0.55 AND distance <= 8) OR (ratio < 0.55 AND distance <= 14)),
common AS (SELECT l, r, count(*) AS k FROM c3 JOIN fe x ON x.path = l JOIN fe y ON y.path = r AND y.topic = x.topic WHERE ratio < 0.55 GROUP BY ALL),
linked AS (SELECT l, r, distance FROM c3 WHERE ratio >= 0.55 UNION ALL SELECT c3.l, c3.r, distance FROM c3 JOIN common USING (l, r) JOIN size_of p ON p.path = l JOIN size_of q ON q.path = r WHERE ratio < 0.55 AND least(p.k, q.k) >= 20 AND common.k / least(p.k, q.k) >= 0.8)"""
ORACLE_SQL["near_duplicate_pairs"] = f"{SIMILAR} SELECT l AS left_path, r AS right_path, distance FROM linked"
ORACLE_SQL["near_duplicate_groups"] = f"""{SIMILAR.replace("WITH ", "WITH RECURSIVE ", 1)}, e AS (SELECT l AS a, r AS b FROM linked UNION SELECT r, l FROM linked), reach AS (SELECT a, b FROM e UNION SELECT x.a, e.b FROM reach x JOIN e ON x.b = e.a),
comp AS (SELECT a AS head, least(a, min(b)) AS c FROM reach GROUP BY a), pl AS (SELECT cls.path, cls.chars, cls.v, coalesce(c, cls.head) AS c FROM cls LEFT JOIN comp USING (head)),
gr AS (SELECT c, count(*) AS size, min(path) AS first_path, max((chars, path)) AS top FROM pl GROUP BY c HAVING count(*) > 1), nm AS (SELECT *, row_number() OVER (ORDER BY size DESC, first_path) AS k FROM gr)
SELECT 'SIM-' || lpad(k::VARCHAR, 4, '0') AS cluster_id, t.path AS representative, pl.path, size, bit_count(xor(pl.v, t.v))::BIGINT AS distance FROM pl JOIN nm USING (c) JOIN pl t ON t.c = pl.c AND (t.chars, t.path) = nm.top"""
ORACLE_SQL["folder_summaries"] = f"""WITH {CANON}, {topics_sql('canon')}, sc AS (SELECT '.' AS scope, path, size, length(text) AS ch FROM canon UNION ALL SELECT array_to_string(string_split(path, '/')[1:k], '/'), path, size, length(text) FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS k FROM canon)),
tc AS (SELECT scope, topic, count(*) AS n FROM sc JOIN topics USING (path) WHERE rank < 5 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, topic) <= 8), tt AS (SELECT scope, string_agg(topic, '|' ORDER BY n DESC, topic) AS topics FROM tc GROUP BY 1),
lo AS (SELECT scope, string_agg(path, '|' ORDER BY ch DESC, size DESC, path) AS representatives FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY scope ORDER BY ch DESC, size DESC, path) <= 3) GROUP BY 1),
g AS (SELECT scope, count(*) AS files, sum(size)::BIGINT AS bytes, sum(ch)::BIGINT AS chars FROM sc GROUP BY 1)
SELECT scope, files, bytes, CASE WHEN bytes < 1024 THEN printf('%.1f B', bytes::DOUBLE) WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0::DOUBLE) WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576.0::DOUBLE) ELSE printf('%.1f GB', bytes / 1073741824.0::DOUBLE) END AS size_human, chars, representatives, coalesce(topics, '') AS topics FROM g JOIN lo USING (scope) LEFT JOIN tt USING (scope)"""
ORACLE_SQL["package_statistics"] = f"""WITH {DOCS}, {chunks_sql('docs')}, {LABELLED}, r AS ({ORACLE_SQL["document_roles"]})
SELECT 'documents' AS name, count(*)::BIGINT AS value FROM docs UNION ALL SELECT 'canonical_documents', count(DISTINCT sha) FROM docs UNION ALL SELECT 'duplicate_aliases', count(*) - count(DISTINCT sha) FROM docs UNION ALL SELECT 'characters', sum(length(text))::BIGINT FROM docs
UNION ALL SELECT 'evidence_units', count(*) FROM judged UNION ALL SELECT 'eligible_units', count(*) FROM judged WHERE reason = 'eligible' UNION ALL SELECT 'parsed_files', count(*) FROM states WHERE parsed UNION ALL SELECT 'failed_files', count(*) FROM states WHERE failed
UNION ALL SELECT 'role:' || role, count(*) FROM r WHERE path NOT LIKE 'pages/%' GROUP BY role"""
ORACLE_SQL["unparsed_files"] = f"WITH {FILES}, {LABELLED} SELECT extension, count(*) AS files, sum(size)::BIGINT AS bytes FROM inv WHERE path NOT IN (SELECT path FROM states WHERE parsed) GROUP BY extension"
ORACLE_SQL["report_categories"] = f"WITH {CANON}, {topics_sql('canon')}, {ASSIGNED} SELECT coalesce(topic, '(none)') AS category, count(*) AS files, sum(size)::BIGINT AS bytes, min(path) AS first_path FROM canon LEFT JOIN held USING (path) GROUP BY 1"
ORACLE_SQL["cluster_names"] = f"""WITH RECURSIVE sim AS ({ORACLE_SQL["near_duplicate_groups"]}), {CANON}, {topics_sql('canon')},
c AS (SELECT cluster_id AS cluster, topic, count(*) AS n FROM sim JOIN topics USING (path) WHERE rank < 8 AND topic NOT IN ('security', 'software', 'system', 'systems', 'hardware', 'data', 'paper', 'abstract', 'introduction', 'using', 'based') GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, topic) <= 3),
n AS (SELECT cluster, string_agg(topic, ' / ' ORDER BY n DESC, topic) AS name FROM c GROUP BY 1), e AS (SELECT cluster, coalesce(name, 'topic ' || cluster) AS name FROM (SELECT DISTINCT cluster_id AS cluster FROM sim) LEFT JOIN n USING (cluster)),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY cluster) AS r FROM e) SELECT cluster, CASE WHEN r > 1 THEN name || ' (' || r || ')' ELSE name END AS name FROM k"""
ORACLE_SQL["package_policy"] = f"WITH {FILES} SELECT CASE WHEN sum(size) >= 1073741824 OR count(*) >= 3000 THEN 'large_package' ELSE 'standard' END AS mode, sum(size) >= 1073741824 OR count(*) >= 3000 AS enabled, count(*) AS inventory_files, sum(size)::BIGINT AS inventory_bytes FROM files"
ORACLE_SQL["even_sample"] = f"WITH {DOCS}, n AS (SELECT path, row_number() OVER (ORDER BY path) AS k, count(*) OVER () AS total FROM docs) SELECT path FROM n WHERE total <= 60 OR k IN (SELECT round_even(i * (total - 1) / 59, 0)::BIGINT + 1 FROM range(60) r(i))"
ORACLE_SQL["alias_members"] = f"WITH {DOCS}, p AS (SELECT path, first_value(path) OVER (PARTITION BY sha ORDER BY size DESC, path) AS head FROM docs) SELECT string_split(head, '/')[1] AS folder, path, path <> head AS duplicate_alias FROM p"
ORACLE_SQL["answer_status"] = f"WITH c AS ({ORACLE_SQL['claim_binding']}) SELECT question_id % 10 AS node_id, CASE WHEN bool_and(claim_status = 'direct') THEN 'supported' WHEN bool_or(claim_status IN ('direct', 'partial')) THEN 'partial' ELSE 'insufficient' END AS answer_status FROM c GROUP BY 1"
SCORED = "CASE reason WHEN 'too_short' THEN -80.0 WHEN 'short_without_fact' THEN -80.0 WHEN 'question' THEN -70.0 WHEN 'topic_phrase' THEN -55.0 ELSE round(least(length(bare), 360) / 18.0 + len(regexp_extract_all(bare, '[。！？；.!?;]')) * 2 + f::INT * 8 + q::INT * 5, 3) END::DOUBLE"
ORACLE_SQL["node_evidence"] = f"""WITH {DOCS}, {chunks_sql('docs')}, sc AS (SELECT '.' AS node_id, path FROM docs UNION ALL SELECT array_to_string(string_split(path, '/')[1:k], '/'), path FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM docs))
SELECT node_id, count(*) AS units, count(*) FILTER (reason = 'eligible') AS eligible_units, count(DISTINCT path) FILTER (reason = 'eligible') AS sources, round(avg({SCORED}) FILTER (reason = 'eligible'), 3) AS mean_score FROM sc JOIN judged USING (path) GROUP BY node_id"""
ORACLE_SQL["cluster_evidence"] = f"""WITH {CANON}, {chunks_sql('canon')}, {topics_sql('canon')}, {CLUSTERS}, u AS (SELECT cluster_id AS node_id, j.path, evidence_id, seq, {SCORED} AS score FROM clusters c JOIN topics t ON t.topic = c.topic AND t.rank < 5 JOIN judged j ON j.path = t.path WHERE reason = 'eligible'),
few AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY node_id, path ORDER BY score DESC, seq) <= 2) SELECT node_id, path, evidence_id, score, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, path, seq) AS place FROM few QUALIFY place <= 5"""


def _parts_sql(most: int = 4) -> str:
    """subparts (topic, part, place, path) from held and topics: each part takes the documents of the next term that still has two."""
    out = """pin AS (SELECT h.topic, h.path, t.topic AS term FROM held h JOIN topics t ON t.path = h.path AND t.rank < 10 AND t.topic <> h.topic),
psize AS (SELECT topic, count(*) AS size FROM held GROUP BY 1),
pterm AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY df DESC, term) AS o FROM (SELECT topic, term, count(*) AS df FROM pin GROUP BY 1, 2) JOIN psize USING (topic) WHERE df >= 2 AND df < size),
left0 AS (SELECT topic, path, term, o, 0 AS after FROM pin JOIN pterm USING (topic, term))"""
    for k in range(most):
        out += f""",
turn{k} AS (SELECT topic, min(o) AS o FROM (SELECT topic, o FROM left{k} WHERE o > after GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
now{k} AS (SELECT topic, path, term AS part, {k} AS place FROM left{k} JOIN turn{k} USING (topic, o)),
left{k + 1} AS (SELECT l.topic, l.path, l.term, l.o, t.o AS after FROM left{k} l JOIN turn{k} t USING (topic) WHERE NOT EXISTS (SELECT 1 FROM now{k} n WHERE n.topic = l.topic AND n.path = l.path))"""
    taken = " UNION ALL ".join(f"SELECT * FROM now{k}" for k in range(most))
    return out + f""",
taken AS ({taken}),
subparts AS (SELECT * FROM taken UNION ALL SELECT topic, path, '(rest)', {most} FROM held h WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.topic = h.topic AND t.path = h.path))"""


PARTS = _parts_sql()
ORACLE_SQL["topic_subtopics"] = f"WITH {CANON}, {topics_sql('canon')}, {ASSIGNED}, {PARTS} SELECT topic, part, place, count(*) AS documents, min(path) AS first_path FROM subparts GROUP BY 1, 2, 3"
ORACLE_SQL["topic_tree"] = f"""WITH {CANON}, {chunks_sql('canon')}, {topics_sql('canon')}, {ASSIGNED}, {PARTS},
levels AS (SELECT 'topic' AS level, topic AS key, NULL AS parent, topic AS name, 8 AS most, topic, part, path FROM subparts UNION ALL SELECT 'part', topic || '|' || part, topic, part, 5, topic, part, path FROM subparts UNION ALL SELECT 'file', topic || '|' || part || '|' || path, topic || '|' || part, path, 3, topic, part, path FROM subparts),
nodes AS (SELECT level, key, parent, name, count(*) AS documents, sum(size)::BIGINT AS total_size FROM levels JOIN canon USING (path) GROUP BY ALL),
u AS (SELECT topic, part, path, evidence_id, seq, {SCORED} AS score, contains(lower(text), topic)::INT + contains(lower(text), part)::INT AS hits FROM subparts JOIN judged USING (path) WHERE reason = 'eligible'),
few AS (SELECT * FROM u WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY topic, part, path ORDER BY hits DESC, score DESC, seq) <= 2),
best AS (SELECT key, evidence_id, row_number() OVER (PARTITION BY key ORDER BY hits DESC, score DESC, path, seq) AS place FROM levels JOIN few USING (topic, part, path) QUALIFY place <= most),
chain AS (SELECT key, string_agg(evidence_id, '|' ORDER BY place) AS evidence FROM best GROUP BY key)
SELECT 'group-' || substr(sha256(key), 1, 16) AS node_id, coalesce('group-' || substr(sha256(parent), 1, 16), 'root') AS parent_id, level, name, documents, total_size, CASE WHEN level = 'file' THEN NULL WHEN documents >= 3 THEN 'high' WHEN documents >= 2 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN evidence IS NULL THEN 'insufficient' ELSE 'supported' END AS evidence_status, coalesce(evidence, '') AS evidence FROM nodes LEFT JOIN chain USING (key)"""
SCOPES = "sc AS (SELECT '.' AS node_id, path FROM {0} UNION ALL SELECT array_to_string(string_split(path, '/')[1:k], '/'), path FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM {0}))"
# A context is filled file by file: a step takes what its file's share and the characters that are left allow.
CONTEXTS = f"""WITH RECURSIVE {DOCS}, {SCOPES.format('docs')}, ranked AS (SELECT node_id, path, row_number() OVER (PARTITION BY node_id ORDER BY path) - 1 AS r, count(*) OVER (PARTITION BY node_id) AS n FROM sc),
places AS (SELECT DISTINCT node_id, round_even(i * (n - 1) / 29.0::DOUBLE, 0)::BIGINT AS r FROM (SELECT DISTINCT node_id, n FROM ranked WHERE n > 30), range(30) t(i)),
chosen AS (SELECT node_id, path, row_number() OVER (PARTITION BY node_id ORDER BY path) AS k, count(*) OVER (PARTITION BY node_id) AS files FROM ranked WHERE n <= 30 OR (node_id, r) IN (SELECT node_id, r FROM places)),
filled AS (
  SELECT node_id, 0::BIGINT AS k, ''::VARCHAR AS path, ''::VARCHAR AS excerpt, 0::BIGINT AS chars, 50000::BIGINT AS rest FROM (SELECT DISTINCT node_id FROM sc)
  UNION ALL
  SELECT f.node_id, c.k, c.path, substr(d.text, 1, least(6000, greatest(800, 50000 // c.files), f.rest)::BIGINT), CASE WHEN d.text = '' THEN 0 ELSE 5 + length(c.path) + least(length(d.text), 6000, greatest(800, 50000 // c.files), f.rest) END,
    f.rest - CASE WHEN d.text = '' THEN 0 ELSE 5 + length(c.path) + least(length(d.text), 6000, greatest(800, 50000 // c.files), f.rest) END
  FROM filled f JOIN chosen c ON c.node_id = f.node_id AND c.k = f.k + 1 JOIN docs d ON d.path = c.path WHERE f.rest > 0
)"""
ORACLE_SQL["context_excerpts"] = CONTEXTS + " SELECT node_id, k AS place, path, chars::BIGINT AS chars, sha256(excerpt) AS excerpt_sha256 FROM filled WHERE k > 0"
ORACLE_SQL["folder_contexts"] = CONTEXTS + f""", used AS (SELECT node_id, count(*) AS sampled_files, sum(chars) AS chars FROM filled WHERE k > 0 GROUP BY 1), totals AS (SELECT node_id, count(*) AS total_files, sum(size)::BIGINT AS total_size FROM sc JOIN docs USING (path) GROUP BY 1)
SELECT node_id, total_files, total_size, {HUMAN.format(b='total_size')} AS total_size_human, '.txt:' || total_files AS types, sampled_files, round(sampled_files / total_files, 6) AS sampled_file_ratio, sampled_files < total_files AS sample_truncated, chars::BIGINT AS chars FROM totals JOIN used USING (node_id)"""
# Candidates of each node in order, then one step for each: taken if it is new, there is room and, from a representative, its cluster has fewer than three of its chain.
CATALOGUE = f"""WITH RECURSIVE {CANON}, {chunks_sql('canon')}, {topics_sql('canon')}, {CLUSTERS}, {SCOPES.format('canon')},
cm AS (SELECT DISTINCT c.cluster_id, t.path FROM clusters c JOIN topics t ON t.topic = c.topic AND t.rank < 5),
u AS (SELECT cluster_id, j.path, evidence_id, seq, {SCORED} AS score FROM cm JOIN judged j USING (path) WHERE reason = 'eligible'),
fewu AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY cluster_id, path ORDER BY score DESC, seq) <= 2),
chain AS (SELECT cluster_id, path, evidence_id, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, path, seq) AS place FROM fewu QUALIFY place <= 5),
reps AS (SELECT cluster_id, path, row_number() OVER (PARTITION BY cluster_id ORDER BY path) AS place FROM cm QUALIFY place <= 5),
docev AS (SELECT path, evidence_id, row_number() OVER (PARTITION BY path ORDER BY seq) AS b FROM judged WHERE reason = 'eligible' QUALIFY b <= 3),
nc AS (SELECT node_id, cluster_id, count(*) AS file_count, list(path ORDER BY path)[1:3] AS firsts FROM sc JOIN cm USING (path) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY cluster_id) <= 8),
nr AS (SELECT nc.node_id, nc.cluster_id, r.path, r.place FROM nc JOIN reps r USING (cluster_id) JOIN sc ON sc.node_id = nc.node_id AND sc.path = r.path QUALIFY row_number() OVER (PARTITION BY nc.node_id, nc.cluster_id ORDER BY r.place) <= 3),
cand AS (SELECT nc.node_id, nc.cluster_id, 0 AS kind, c.place AS a, 0 AS b, c.path, c.evidence_id FROM nc JOIN chain c USING (cluster_id) JOIN sc ON sc.node_id = nc.node_id AND sc.path = c.path
  UNION ALL SELECT nr.node_id, nr.cluster_id, 1, nr.place, e.b, nr.path, e.evidence_id FROM nr JOIN docev e USING (path)),
steps AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY cluster_id, kind, a, b) AS k FROM cand),
walk AS (
  SELECT node_id, 0::BIGINT AS k, NULL::VARCHAR AS cluster_id, NULL::INT AS kind, NULL::VARCHAR AS path, NULL::VARCHAR AS evidence_id, false AS taken, []::VARCHAR[] AS seen, 0::BIGINT AS own FROM (SELECT DISTINCT node_id FROM steps)
  UNION ALL
  SELECT node_id, k, cluster_id, kind, path, evidence_id, ok, CASE WHEN ok THEN list_append(seen, evidence_id) ELSE seen END, own + (ok AND kind = 0)::INT
  FROM (SELECT w.node_id, s.k, s.cluster_id, s.kind, s.path, s.evidence_id, w.seen, CASE WHEN s.cluster_id = w.cluster_id THEN w.own ELSE 0 END AS own,
      NOT list_contains(w.seen, s.evidence_id) AND len(w.seen) < 18 AND (s.kind = 0 OR CASE WHEN s.cluster_id = w.cluster_id THEN w.own ELSE 0 END < 3) AS ok
    FROM walk w JOIN steps s ON s.node_id = w.node_id AND s.k = w.k + 1)
), taken AS (SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY k) AS place, cluster_id, evidence_id, path, kind FROM walk WHERE taken)"""
ORACLE_SQL["evidence_catalogue"] = CATALOGUE + " SELECT node_id, place, cluster_id, evidence_id, path, CASE WHEN kind = 0 THEN 'chain' ELSE 'representative' END AS origin FROM taken"
ORACLE_SQL["node_clusters"] = CATALOGUE + """, ended AS (SELECT node_id, max(cluster_id) AS last FROM taken GROUP BY 1 HAVING count(*) >= 18)
SELECT nc.node_id, nc.cluster_id, file_count, array_to_string(coalesce((SELECT list(path ORDER BY place) FROM nr WHERE nr.node_id = nc.node_id AND nr.cluster_id = nc.cluster_id), firsts), '|') AS representative_documents,
  coalesce((SELECT string_agg(evidence_id, '|' ORDER BY place) FROM taken t WHERE t.node_id = nc.node_id AND t.cluster_id = nc.cluster_id), '') AS evidence_ids
FROM nc LEFT JOIN ended ON ended.node_id = nc.node_id WHERE last IS NULL OR nc.cluster_id <= last"""
