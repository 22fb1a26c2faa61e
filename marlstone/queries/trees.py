"""Queries over the analysis tree of the documents' folders, with edits, and over the order of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deep_tree, edit_log, evidence, tree
from ..storage import materialize, numbered
from .common import DOCS, documents, table

EDITS = [
    {"edit_id": "e1", "operation": "rename", "payload": {"node_id": "en", "name": "English"}},
    {"edit_id": "e2", "operation": "confirm", "payload": {"node_id": "fr"}},
    {"edit_id": "e3", "operation": "mount", "payload": {"node_id": "es", "path": "extra/one.txt"}},
    {"edit_id": "e4", "operation": "rename", "payload": {"node_id": "es", "name": "dropped"}},
    {"edit_id": "e5", "operation": "undo", "payload": {"edit_id": "e4"}},
    {"edit_id": "e6", "operation": "merge", "payload": {"node_ids": ["de", "fr"], "name": "Continental"}},
]


def language_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A group for each language, its documents as members."""
    members = documents(spark, sf_dir).select(F.element_at(F.split("path", "/"), 1).alias("node_id"), "path")
    nodes = members.select("node_id").distinct().select("node_id", F.lit("root").alias("parent_id"), F.col("node_id").alias("name"), F.lit("group").alias("kind"), F.ascii("node_id").alias("position"), F.lit(False).alias("confirmed"))
    return nodes, members


def tree_edit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, members = tree.replay(*language_tree(spark, sf_dir), EDITS)
    sizes = members.groupBy("node_id").agg(F.count("*").alias("files"))
    return nodes.join(sizes, "node_id").select("node_id", "name", "confirmed", "files")


def tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose labels make them of low confidence."""
    nodes, members = language_tree(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = documents(spark, sf_dir).select("doc_id", "path").join(labels, "doc_id", "left")
    leaves = members.join(found, "path").select("node_id", "path", F.when(F.col("quality").isNull(), "unclassified").otherwise("classified").alias("status"), F.col("quality").cast("double").alias("confidence"), F.lit(False).alias("confirmed"))
    return tree.filter_tree(nodes, leaves, "low_confidence")


def folder_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and documents as nodes: node_id (the path), parent_id, kind, size."""
    docs = documents(spark, sf_dir)
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = docs.select(F.explode(up).alias("node_id")).distinct()
    parent = F.regexp_replace("node_id", r"/?[^/]*$", "")
    both = folders.select("node_id", F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("size")).unionByName(docs.select(F.col("path").alias("node_id"), F.lit("file").alias("kind"), "size"))
    inner = both.select("node_id", F.when(parent == "", ".").otherwise(parent).alias("parent_id"), "kind", "size")
    return inner.unionByName(spark.createDataFrame([(".", None, "directory", 0)], "node_id string, parent_id string, kind string, size long"))


def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder and document in pre-order, with its depth, and the files and bytes at and below it."""
    nodes = materialize(folder_nodes(spark, sf_dir), "nodes")
    above = deep_tree.ancestors(nodes)
    figures = nodes.filter("kind = 'file'").select("node_id", F.lit(1).cast("long").alias("files"), F.col("size").alias("bytes"))
    return deep_tree.pre_order(nodes, above, ["node_id"]).join(deep_tree.depths(nodes), "node_id").join(deep_tree.rolled_up(nodes, above, figures), "node_id")


def pruned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder tree with the documents of low confidence alone."""
    nodes = materialize(folder_nodes(spark, sf_dir), "nodes")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = documents(spark, sf_dir).select("doc_id", "path").join(labels, "doc_id", "left")
    leaves = found.select(F.col("path").alias("node_id"), "path", F.when(F.col("quality").isNull(), "unclassified").otherwise("classified").alias("status"), F.col("quality").cast("double").alias("confidence"), F.lit(False).alias("confirmed"))
    kept = tree.filter_files(leaves, "low_confidence")
    return deep_tree.pruned(nodes, deep_tree.ancestors(nodes), kept).select("node_id", "parent_id", "kind", "kept_files")


def event_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups by source, their documents, and a log in which each event is an edit: names, confirmations, added paths, undo; and a merge and a split among them."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("node_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    nodes = docs.select("node_id").distinct().select("node_id", F.lit("root").alias("parent_id"), F.col("node_id").alias("name"), F.lit("group").alias("kind"), F.ascii(F.substring("node_id", -1, 1)).alias("position"), F.lit(False).alias("confirmed"))
    merged = edit_log.manual_id("merge", F.lit("src0|src1"))
    kind, none = F.col("event_type"), lambda t: F.lit(None).cast(t)
    number = F.col("user_id") % 22
    node = F.when(number == 21, merged).otherwise(F.concat(F.lit("src"), number.cast("string")))
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("seq"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("edit_id"),
        F.when(kind == "view", "rename").when(kind == "click", "confirm").when(kind == "purchase", "mount").otherwise("undo").alias("operation"), node.alias("node_id"),
        F.concat(F.lit("name "), F.col("event_id").cast("string")).alias("name"), (F.col("event_id") % 3 == 0).alias("confirmed"), F.concat(F.lit("extra/"), (F.col("event_id") % 100).cast("string")).alias("path"),
        F.when(kind.isin("view", "click", "purchase"), None).otherwise(F.concat(F.lit("e"), (F.col("event_id") - F.col("event_id") % 7).cast("string"))).alias("target"), none("array<string>").alias("node_ids"), none("array<struct<name:string,paths:array<string>>>").alias("groups"),
    )
    last = table(spark, sf_dir, "events").agg(F.max("event_id").cast("long").alias("last"))
    few = docs.filter("node_id = 'src2'").orderBy("path").limit(10).agg(F.sort_array(F.collect_list("path")).alias("p"))  # ten paths
    half = last.select((F.floor(F.col("last") / 2)).alias("seq"), F.lit("m").alias("edit_id"), F.lit("merge").alias("operation"), none("string").alias("node_id"), F.lit("pair").alias("name"), none("boolean").alias("confirmed"), none("string").alias("path"), none("string").alias("target"), F.array(F.lit("src0"), F.lit("src1")).alias("node_ids"), none("array<struct<name:string,paths:array<string>>>").alias("groups"))
    parts = F.array(F.struct(F.lit("one").alias("name"), F.slice("p", 1, 5).alias("paths")), F.struct(F.lit("two").alias("name"), F.slice("p", 6, 5).alias("paths")))
    third = few.join(F.broadcast(last), F.lit(True)).select((F.floor(F.col("last") / 3)).alias("seq"), F.lit("s").alias("edit_id"), F.lit("split").alias("operation"), F.lit("src2").alias("node_id"), none("string").alias("name"), none("boolean").alias("confirmed"), none("string").alias("path"), none("string").alias("target"), none("array<string>").alias("node_ids"), parts.alias("groups"))
    return nodes, docs, events.unionByName(half).unionByName(third)


def edit_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, members = edit_log.replayed(*event_log(spark, sf_dir))
    sizes = members.groupBy("node_id").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))
    return nodes.join(sizes, "node_id", "left").select("node_id", "name", "confirmed", F.coalesce("files", F.lit(0)).alias("files"), "first_path")


def job_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user as a job, in the order of a task list: running (clicks), queued (views and sign-ups), done; and the place of those that wait."""
    last = evidence.latest_by_key(table(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"))
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type").isin("view", "signup"), "queued").otherwise("completed")
    jobs = materialize(last.select("user_id", status.alias("status"), "event_id", F.floor("value").cast("long").alias("priority")), "jobs")
    bucket = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).otherwise(2)
    listed = numbered(jobs, [bucket, -F.col("event_id")], "list_position")
    waiting = numbered(jobs.filter("status = 'queued'"), [-F.coalesce("priority", F.lit(0)), F.col("event_id")], "queue_position").select("user_id", "queue_position")
    return listed.join(waiting, "user_id", "left").select("user_id", "status", "queue_position", "list_position")


QUERIES = {f.__name__: f for f in (tree_edit_replay, edit_log_replay, tree_filter, tree_order, pruned_tree, job_queue_order)}
NODES = f"""{DOCS}, folders AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS node_id FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM docs)),
nodes AS (SELECT '.' AS node_id, NULL::VARCHAR AS parent_id, 'directory' AS kind, 0::BIGINT AS size UNION ALL
  SELECT node_id, CASE WHEN contains(node_id, '/') THEN regexp_replace(node_id, '/[^/]*$', '') ELSE '.' END, kind, size FROM (SELECT node_id, 'directory' AS kind, 0::BIGINT AS size FROM folders UNION ALL SELECT path, 'file', size FROM docs)),
up AS (SELECT node_id, node_id AS anc, 0 AS d, kind, size FROM nodes UNION ALL SELECT up.node_id, n.parent_id, d + 1, up.kind, up.size FROM up JOIN nodes n ON n.node_id = up.anc WHERE n.parent_id IS NOT NULL)"""

ORACLE_SQL = {
    "edit_log_replay": """WITH d AS (SELECT coalesce(source, 'none') AS node_id, 'd/' || doc_id AS path FROM documents), last AS (SELECT max(event_id)::BIGINT AS last FROM events),
mid AS (SELECT 'manual-merge-' || sha256('src0|src1')[:16] AS mid), p AS (SELECT list(path ORDER BY path)[1:10] AS p FROM d WHERE node_id = 'src2'),
part AS (SELECT 1 AS k, 'one' AS name, p[1:5] AS paths FROM p UNION ALL SELECT 2, 'two', p[6:10] FROM p),
made AS (SELECT k, name, paths, 'manual-split-' || sha256('src2|' || k || '|' || array_to_string(list_sort(paths), '|'))[:16] AS node_id FROM part WHERE len(paths) > 0),
fits AS (SELECT count(*) = 2 AS parted, (SELECT count(DISTINCT node_id) = 2 FROM d WHERE node_id IN ('src0', 'src1')) AS paired FROM made),
log AS (SELECT event_id AS seq, 'e' || event_id AS edit_id, CASE event_type WHEN 'view' THEN 'rename' WHEN 'click' THEN 'confirm' WHEN 'purchase' THEN 'mount' ELSE 'undo' END AS op, CASE WHEN user_id % 22 = 21 THEN mid ELSE 'src' || user_id % 22 END AS node_id, 'e' || (event_id - event_id % 7) AS target FROM events, mid),
act AS (SELECT * FROM log WHERE op <> 'undo' AND edit_id NOT IN (SELECT target FROM log WHERE op = 'undo')),
cut AS (SELECT last // 2 AS m, last // 3 AS s FROM last),
lives AS (SELECT DISTINCT node_id, -1 AS born, CASE WHEN node_id IN ('src0', 'src1') AND paired THEN m WHEN node_id = 'src2' AND parted THEN s END AS died, node_id AS name, false AS confirmed FROM d, cut, fits
  UNION ALL SELECT mid, m, NULL, 'pair', coalesce((SELECT arg_max(seq % 3 = 0, seq) FROM act, cut WHERE op = 'confirm' AND node_id = 'src0' AND seq < m), false) FROM mid, cut, fits WHERE paired
  UNION ALL SELECT node_id, s, NULL, name, true FROM made, cut, fits WHERE parted),
held AS (SELECT node_id, path, -1 AS since, false AS mounted FROM d UNION ALL SELECT node_id, 'extra/' || seq % 100, seq, true FROM act WHERE op = 'mount'),
kept AS (SELECT node_id, path, since FROM held JOIN lives USING (node_id) WHERE (NOT mounted OR since > born) AND (died IS NULL OR since < died)),
files AS (SELECT node_id, path FROM kept UNION SELECT mid, path FROM kept, mid, fits, cut WHERE node_id IN ('src0', 'src1') AND paired AND since < m UNION SELECT node_id, unnest(paths) FROM made),
sizes AS (SELECT node_id, count(*) AS files, min(path) AS first_path FROM files GROUP BY 1),
wrote AS (SELECT l.node_id, arg_max('name ' || seq, seq) FILTER (op = 'rename') AS new_name, arg_max(seq % 3 = 0, seq) FILTER (op = 'confirm') AS mark FROM lives l JOIN act a ON a.node_id = l.node_id AND a.seq > born AND (died IS NULL OR a.seq < died) GROUP BY 1)
SELECT l.node_id, coalesce(new_name, name) AS name, coalesce(mark, confirmed) AS confirmed, coalesce(files, 0) AS files, first_path FROM lives l LEFT JOIN sizes USING (node_id) LEFT JOIN wrote USING (node_id) WHERE died IS NULL""",
    "tree_order": f"""WITH RECURSIVE {NODES}, keys AS (SELECT node_id, list(anc ORDER BY d DESC) AS way, max(d) AS depth FROM up GROUP BY 1), sums AS (SELECT anc AS node_id, count(*) FILTER (kind = 'file') AS files, sum(size)::BIGINT AS bytes FROM up GROUP BY 1)
SELECT node_id, row_number() OVER (ORDER BY way) AS place, depth::BIGINT AS depth, files, bytes FROM keys JOIN sums USING (node_id)""",
    "pruned_tree": f"""WITH RECURSIVE {NODES}, l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1), kept AS (SELECT path AS node_id FROM docs JOIN l USING (doc_id) WHERE q < 0.65),
stay AS (SELECT DISTINCT anc AS node_id FROM up WHERE node_id IN (SELECT node_id FROM kept)), direct AS (SELECT n.parent_id AS node_id, count(*) AS k FROM nodes n JOIN kept USING (node_id) GROUP BY 1)
SELECT node_id, parent_id, kind, coalesce(k, 0) AS kept_files FROM nodes JOIN stay USING (node_id) LEFT JOIN direct USING (node_id)""",
    "tree_edit_replay": f"""WITH {DOCS}, m AS (SELECT string_split(path, '/')[1] AS lang, path FROM docs UNION ALL SELECT 'es', 'extra/one.txt')
SELECT CASE WHEN lang IN ('de', 'fr') THEN 'manual-merge-' || substr(sha256('de|fr'), 1, 16) ELSE lang END AS node_id, CASE WHEN lang IN ('de', 'fr') THEN 'Continental' WHEN lang = 'en' THEN 'English' ELSE lang END AS name, false AS confirmed, count(*) AS files FROM m GROUP BY 1, 2""",
    "tree_filter": f"""WITH {DOCS}, l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) SELECT string_split(path, '/')[1] AS node_id, string_split(path, '/')[1] AS name, count(*) AS files FROM docs JOIN l USING (doc_id) WHERE q < 0.65 GROUP BY 1, 2""",
    "job_queue_order": """WITH l AS (SELECT *, CASE WHEN event_type = 'click' THEN 'running' WHEN event_type IN ('view', 'signup') THEN 'queued' ELSE 'completed' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, status, CASE WHEN status = 'queued' THEN row_number() OVER (PARTITION BY status ORDER BY coalesce(floor(value), 0) DESC, event_id) END AS queue_position, row_number() OVER (ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, event_id DESC) AS list_position FROM l""",
}
