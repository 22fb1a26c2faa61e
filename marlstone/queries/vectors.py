"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, semantic, summary, topics
from ..storage import materialize
from .common import DOCS, HUMAN, documents, table, topics_sql


def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return clusters.neighbours(rows, asked).withColumn("similarity", F.round("similarity", 4))


def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


def sign_bucket_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return clusters.sign_buckets(rows, rows.count())


def embedding_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other row of every row."""
    near = semantic.nearest_similarities(table(spark, sf_dir, "embeddings"))
    return near.withColumn("similarity", F.round("similarity", 4))


def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average link over all rows, with the threshold that they set."""
    return clusters.average_link(table(spark, sf_dir, "embeddings"), small=100).withColumns({"mean_similarity": F.round("mean_similarity", 4), "threshold": F.round("threshold", 4)})


def semantic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the documents that have a vector, its groups named by their words."""
    rows = table(spark, sf_dir, "embeddings")
    docs = documents(spark, sf_dir)
    found = clusters.average_link(rows).join(docs.select(F.col("doc_id").alias("vec_id"), "path"), "vec_id")
    found = materialize(found, "placed-documents")
    names = summary.cluster_names(found.select("cluster", "path"), topics.content_topics(docs.join(found.select("path"), "path", "left_semi"), 8))
    return semantic.semantic_tree(found, docs, names).withColumn("mean_similarity", F.round("mean_similarity", 4))


def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wanted by their text's hash, of which those with a vector under their id are in the cache."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("cache_key"), F.lit("local").alias("model"))
    cached = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return clusters.cache_misses(docs, cached)


GENERAL = ", ".join(f"'{w}'" for w in summary.GENERAL_WORDS)

QUERIES = {f.__name__: f for f in (embedding_nearest, semantic_clusters, semantic_tree, embedding_neighbours, embedding_clusters, sign_bucket_clusters, embedding_cache_misses)}
# The reference rule, pair by pair: the closest two clusters merge until they are below the threshold.
LINKED = """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
sim AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id),
near AS (SELECT vec_id, greatest(0, max(s)) AS s FROM e JOIN (SELECT i, s FROM sim UNION ALL SELECT j, s FROM sim) ON i = vec_id GROUP BY 1),
th AS (SELECT greatest(0.46, least(0.72, 0.86 * s)) AS t FROM near QUALIFY row_number() OVER (ORDER BY s, vec_id) = count(*) OVER () // 2 + 1),
walk AS (SELECT 0 AS step, vec_id, vec_id AS cluster FROM e
  UNION ALL
  SELECT step + 1, vec_id, CASE WHEN cluster = hi THEN lo ELSE cluster END FROM walk, (
    SELECT lo, hi FROM (SELECT least(a.cluster, b.cluster) AS lo, greatest(a.cluster, b.cluster) AS hi, round(avg(s), 12) AS m FROM sim JOIN walk a ON a.vec_id = i JOIN walk b ON b.vec_id = j WHERE a.cluster <> b.cluster GROUP BY 1, 2 ORDER BY m DESC, lo, hi LIMIT 1), th WHERE m >= t)),
placed AS (SELECT vec_id, cluster FROM walk WHERE step = (SELECT max(step) FROM walk)),
inside AS (SELECT p.cluster, i, j, s FROM sim JOIN placed p ON p.vec_id = i JOIN placed q ON q.vec_id = j WHERE p.cluster = q.cluster),
sizes AS (SELECT cluster, count(*) AS size FROM placed GROUP BY 1),
means AS (SELECT cluster, round(avg(s), 4) AS mean_similarity FROM inside GROUP BY 1),
central AS (SELECT vec_id, coalesce(round(avg(s), 12), 1.0) AS c FROM placed LEFT JOIN (SELECT i, s FROM inside UNION ALL SELECT j, s FROM inside) ON i = vec_id GROUP BY 1),
linked AS (SELECT p.vec_id, 'SEM-' || lpad(dense_rank() OVER (ORDER BY size DESC, p.cluster)::VARCHAR, 4, '0') AS cluster_id, p.cluster, size, row_number() OVER (PARTITION BY p.cluster ORDER BY c DESC, p.vec_id) AS r, mean_similarity FROM placed p JOIN sizes USING (cluster) LEFT JOIN means USING (cluster) JOIN central ON central.vec_id = p.vec_id)"""

ORACLE_SQL = {
    "embedding_nearest": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, b.vec_id AS nearest_id, round(list_cosine_similarity(a.v, b.v), 4) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) = 1",
    "semantic_clusters": LINKED + " SELECT vec_id, cluster_id, cluster, size, CASE WHEN r <= 3 THEN r END AS place, mean_similarity, round(t, 4) AS threshold FROM linked, th",
    "semantic_tree": LINKED + f""", {DOCS}, {topics_sql('docs')},
placed_docs AS (SELECT l.*, d.path, d.size AS bytes, d.doc_id || '.txt' AS file FROM linked l JOIN docs d ON d.doc_id = l.vec_id),
word AS (SELECT cluster, topic, count(*) AS n FROM placed_docs JOIN topics USING (path) WHERE rank < 8 AND topic NOT IN ({GENERAL}) GROUP BY 1, 2),
called AS (SELECT cluster, string_agg(topic, ' / ' ORDER BY n DESC, topic) AS name FROM (SELECT * FROM word QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, topic) <= 3) GROUP BY 1),
each AS (SELECT cluster, coalesce(name, 'topic ' || cluster) AS name FROM (SELECT DISTINCT cluster FROM placed_docs) LEFT JOIN called USING (cluster)),
once AS (SELECT cluster, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY cluster) > 1 THEN name || ' (' || row_number() OVER (PARTITION BY name ORDER BY cluster) || ')' ELSE name END AS name FROM each),
grp AS (SELECT cluster, cluster_id, once.name, count(*) AS files, sum(bytes)::BIGINT AS total_size, min(path) AS first, max(mean_similarity) AS mean_similarity FROM placed_docs JOIN once USING (cluster) GROUP BY ALL),
g AS (SELECT *, 'group-' || sha256(name || '|' || files || '|' || first)[:16] AS node_id FROM grp),
nodes AS (SELECT node_id, 'root' AS parent_id, 'group' AS kind, name, NULL::VARCHAR AS path, files, total_size, cluster_id, mean_similarity, NULL::BIGINT AS place FROM g
  UNION ALL SELECT 'file-' || sha256(path)[:16], g.node_id, 'file', file, path, 1, bytes, p.cluster_id, NULL, CASE WHEN r <= 3 THEN r END FROM placed_docs p JOIN g USING (cluster))
SELECT *, {HUMAN.format(b='total_size')} AS total_size_human FROM nodes""",
    "embedding_neighbours": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, round(similarity, 4) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY p.similarity DESC, vec_id) AS rank FROM p QUALIFY rank <= 10""",
    "sign_bucket_clusters": "SELECT vec_id, list_sum(list_transform(embedding[1:16], lambda x, i: CASE WHEN x >= 0 THEN 1::BIGINT << (least(16, len(embedding)) - i)::INT ELSE 0 END))::BIGINT % greatest(8, least(96, round(sqrt((SELECT count(*) FROM embeddings)))))::BIGINT AS bucket FROM embeddings",
    "embedding_cache_misses": "WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS k FROM documents) SELECT DISTINCT k AS cache_key, 'local' AS model FROM d WHERE k NOT IN (SELECT k FROM d JOIN embeddings ON vec_id = doc_id)",
}
