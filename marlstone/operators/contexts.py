"""What stands for a node (a folder or a topic) within a budget: samples of its texts, and a catalogue of its evidence.

All nodes are filled at once. What a node takes depends on what it has taken
before, but every list is cut to what its budget can hold first, and the running
budget is a running sum, so nothing walks the nodes one after the other and a node
that holds all documents is one among others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import human_size
from ..storage import materialize, numbered
from .inventory import first_rows

# Files and characters of a context, and what one file may have of them.
MOST_FILES, MOST_CHARS = 30, 50_000
FILE_CHARS, LEAST_FILE_CHARS = 6000, 800
MOST_CLUSTERS, MOST_EVIDENCE, TOP_UP_BELOW, REPRESENTATIVES = 8, 18, 3, 3


def even_members(members: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """node_id, path, rank (from 0), total: at most ``most`` paths of each node, at even distances in their order.

    Ranks come from one running count over all nodes, so a node may have any number of paths.
    """
    dealt = materialize(numbered(members.select("node_id", "path").distinct(), ["node_id", "path"], "n"), "members")
    each = dealt.groupBy("node_id").agg((F.min("n")).alias("first"), F.count("*").alias("total"))
    ranked = dealt.join(each, "node_id").select("node_id", "path", (F.col("n") - F.col("first")).alias("rank"), "total")
    if most <= 1:
        return ranked.filter(F.col("rank") < most)
    step = F.greatest(F.col("total") - 1, F.lit(1)) / F.lit(float(most - 1))
    near = F.floor(F.col("rank") / step)
    # a rank is chosen if one of the even places rounds to it (halves to the even rank)
    chosen = F.exists(F.sequence(near - 1, near + 1), lambda i: F.rint(i * (F.col("total") - 1) / F.lit(float(most - 1))) == F.col("rank"))
    return ranked.filter((F.col("total") <= most) | chosen)


def node_contexts(members: DataFrame, docs: DataFrame, *, most_files: int = MOST_FILES, most_chars: int = MOST_CHARS) -> tuple[DataFrame, DataFrame]:
    """Totals of each node, and the excerpts that stand for it.

    members: node_id, path. docs: path, size, extension, text. An excerpt is a
    file's name and the beginning of its text, at most what the file's share of the
    node's characters and the characters that are left allow; a file without text
    takes none. Files come by path; when nothing is left, the others are not looked at.
    """
    sampled = materialize(even_members(members, most_files), "sampled")
    chosen = sampled.withColumn("files", F.count("*").over(W.partitionBy("node_id")))  # ``most_files`` rows a node
    share = F.least(F.lit(FILE_CHARS), F.greatest(F.lit(LEAST_FILE_CHARS), F.floor(F.lit(most_chars) / F.col("files")).cast("int")))
    heads = docs.select("path", "size", "extension", F.substring(F.coalesce("text", F.lit("")), 1, FILE_CHARS).alias("head"))
    met = chosen.join(heads, "path").withColumns({"share": share, "title": F.concat(F.lit("### "), F.col("path"), F.lit("\n"))})
    wanted = F.least(F.length("head"), F.col("share"))
    takes = F.when(wanted > 0, F.length("title") + wanted).otherwise(0)
    before = F.sum(takes).over(W.partitionBy("node_id").orderBy("path")) - takes
    # all excerpts before the last are whole, so what is left is the budget less their sum
    left = met.withColumns({"wanted": wanted, "left": F.lit(most_chars) - before}).filter("left > 0")
    text = F.substring(F.col("head"), F.lit(1), F.least("wanted", "left").cast("int"))
    place = F.row_number().over(W.partitionBy("node_id").orderBy("path"))
    items = left.select("node_id", place.cast("long").alias("place"), "path", "extension", "size", text.alias("excerpt"), F.when(F.col("wanted") > 0, F.length("title") + F.length(text)).otherwise(0).cast("long").alias("chars"))
    items = materialize(items, "excerpts")
    narrow = docs.select("path", "size", "extension")
    by_type = members.select("node_id", "path").distinct().join(narrow, "path").groupBy("node_id", "extension").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    types = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("extension").alias("e"))))  # extensions of a node
    totals = by_type.groupBy("node_id").agg(F.sum("n").alias("total_files"), F.sum("bytes").alias("total_size"), F.array_join(F.transform(types, lambda x: F.concat(x["e"], F.lit(":"), (-x["o"]).cast("string"))), "|").alias("types"))
    used = items.groupBy("node_id").agg(F.count("*").alias("sampled_files"), F.sum("chars").alias("chars"))
    out = totals.join(used, "node_id", "left").select(
        "node_id", "total_files", "total_size", human_size(F.col("total_size")).alias("total_size_human"), "types",
        F.coalesce("sampled_files", F.lit(0)).alias("sampled_files"), F.round(F.coalesce("sampled_files", F.lit(0)) / F.col("total_files"), 6).alias("sampled_file_ratio"),
        (F.coalesce("sampled_files", F.lit(0)) < F.col("total_files")).alias("sample_truncated"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"),
    )
    return out, items


def evidence_catalogue(clusters: DataFrame, cluster_members: DataFrame, chains: DataFrame, representatives: DataFrame, units: DataFrame, members: DataFrame, *, most_clusters: int = MOST_CLUSTERS, most_evidence: int = MOST_EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """The evidence that each node shows, and the clusters that it comes from.

    clusters: cluster_id, position. cluster_members: cluster_id, path. chains:
    cluster_id, place, path, evidence_id. representatives: cluster_id, place, path.
    units: path, place, evidence_id (eligible, in order). members: node_id, path.

    A node takes its clusters in order, those with a document in it, and of each
    the chain's evidence from the node's documents. A cluster that has given fewer
    than three is topped up from its representative documents in the node, three
    units of three documents at most. No evidence comes twice in a node. After
    ``most_clusters`` clusters, or once ``most_evidence`` are taken, a node is full.
    """
    inside = _inside(cluster_members, members)
    met = materialize(first_rows(inside.join(clusters, "cluster_id"), ["node_id"], [F.col("position"), F.col("cluster_id")], most_clusters), "node-clusters")
    heads = met.select("node_id", "cluster_id", "position")
    own = members.select("node_id", "path").distinct()
    # a node holds at most ``most_evidence``, so no more than twice that of one chain can matter: those and ones already seen
    chain = first_rows(heads.join(chains, "cluster_id").join(own, ["node_id", "path"]), ["node_id", "cluster_id"], [F.col("place"), F.col("evidence_id")], 2 * most_evidence)
    few = first_rows(heads.join(representatives, "cluster_id").join(own, ["node_id", "path"]), ["node_id", "cluster_id"], [F.col("place"), F.col("path")], REPRESENTATIVES)
    few = materialize(few.withColumnRenamed("place", "doc_place"), "representatives")
    first = first_rows(units, ["path"], [F.col("place"), F.col("evidence_id")], TOP_UP_BELOW)
    more = few.join(first, "path").select("node_id", "cluster_id", "position", F.lit(1).alias("kind"), F.col("doc_place").cast("long").alias("a"), F.col("place").cast("long").alias("b"), "path", "evidence_id")
    listed = chain.select("node_id", "cluster_id", "position", F.lit(0).alias("kind"), F.col("place").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "path", "evidence_id").union(more)
    order = F.struct(F.col("position").cast("long").alias("position"), "cluster_id", "kind", "a", "b", "evidence_id", "path")
    # most_clusters lists of at most 2 x most_evidence + 9 rows each
    lists = listed.groupBy("node_id").agg(F.array_sort(F.collect_list(order)).alias("items"))
    taken = materialize(lists.select("node_id", F.posexplode(_filled(F.col("items"), most_evidence)).alias("place", "x")), "catalogue")
    catalogue = taken.select("node_id", (F.col("place") + 1).cast("long").alias("place"), "x.cluster_id", "x.evidence_id", "x.path", F.when(F.col("x.kind") == 0, "chain").otherwise("representative").alias("origin"))
    # clusters after the one that fills the node are not listed
    full = taken.groupBy("node_id").agg(F.count("*").alias("k"), F.max(F.struct("x.position", "x.cluster_id")).alias("last")).filter(F.col("k") >= most_evidence)
    ids = taken.groupBy("node_id", F.col("x.cluster_id").alias("cluster_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x.evidence_id"))), lambda e: e["evidence_id"]).alias("evidence_ids"))
    shown = few.groupBy("node_id", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_place", "path"))), lambda e: e["path"]).alias("shown"))
    seen = met.join(full, "node_id", "left").filter(F.col("last").isNull() | (F.struct(F.col("position").cast("long").alias("position"), "cluster_id") <= F.col("last")))
    out = seen.join(ids, ["node_id", "cluster_id"], "left").join(shown, ["node_id", "cluster_id"], "left")
    return catalogue, out.select("node_id", "cluster_id", "file_count", F.array_join(F.coalesce("shown", "some"), "|").alias("representative_documents"), F.coalesce(F.array_join("evidence_ids", "|"), F.lit("")).alias("evidence_ids"))


def _inside(cluster_members: DataFrame, members: DataFrame) -> DataFrame:
    """node_id, cluster_id, file_count and the first documents of each cluster in each node."""
    both = materialize(cluster_members.select("cluster_id", "path").distinct().join(members.select("node_id", "path").distinct(), "path"), "inside")
    counts = both.groupBy("node_id", "cluster_id").agg(F.count("*").alias("file_count"))
    first = first_rows(both, ["node_id", "cluster_id"], [F.col("path")], REPRESENTATIVES).groupBy("node_id", "cluster_id").agg(F.array_sort(F.collect_list("path")).alias("some"))
    return counts.join(first, ["node_id", "cluster_id"])


def _filled(items: Column, most: int) -> Column:
    """The items that a node takes, in order: new ones while there is room; those of representatives only where the cluster's own were too few."""

    def step(done: Column, x: Column) -> Column:
        of_cluster = F.size(F.filter(done, lambda d: (d["cluster_id"] == x["cluster_id"]) & (d["kind"] == 0)))
        new = ~F.exists(done, lambda d: d["evidence_id"] == x["evidence_id"])
        return F.when(new & (F.size(done) < most) & ((x["kind"] == 0) | (of_cluster < TOP_UP_BELOW)), F.concat(done, F.array(x))).otherwise(done)

    return F.aggregate(items, F.slice(items, 1, 0), step)
