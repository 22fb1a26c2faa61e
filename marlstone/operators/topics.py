"""Topics of documents, topic clusters, assignment to shared topics, subtopics, mounts, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import topic_words
from ..storage import materialize, small
from .inventory import first_rows, most_common_frequency, shared_topic_limit

# Words that tell what kind of material a document is, and the names of the kinds.
REQUIREMENT = ["交付要求", "验收标准", "产品定位", "用户故事", "环境约束", "实施要求", "功能要求", "需求规格", "招标文件"]
WEAK_REQUIREMENT = ["技术方案", "系统设计", "实施方案", "项目说明"]
RESEARCH = ["摘要", "关键词", "参考文献", "研究方法", "实验结果", "conclusion", "abstract", "references", "methodology"]
DATA = ["销售额", "增长率", "统计", "样本量", "指标", "合计", "平均值", "dataset"]
OVERVIEW_MARK = "情况概览报告"
ROLES = {"unrecognised": "内容待识别", "overview": "派生概览材料", "data": "结构化数据", "research": "研究文献", "requirement": "要求与说明材料", "general": "一般资料"}


def content_topics(docs: DataFrame, limit: int = 8, headings: Column | None = None) -> DataFrame:
    """path, rank (from 0), topic, n: the most frequent words of each whole text, first seen first among equals.

    Words of a text are counted in its own task first; one row for each distinct
    word of a text is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    sample = F.concat_ws(" ", headings, text) if headings is not None else text
    found = docs.select("path", F.posexplode(topic_words(sample)).alias("pos", "topic")).groupBy("path", "topic").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), "pos")) - 1)
    return ranked.filter(F.col("rank") < limit).select("path", "rank", "topic", "n")


def shared_topics(topics: DataFrame, documents: int) -> DataFrame:
    """topic, df: found in two documents or more, but not in nearly all; the most frequent 6, 8 or 12."""
    df = topics.groupBy("topic").agg(F.count("*").alias("df"))
    return df.filter(F.col("df").between(2, most_common_frequency(documents))).orderBy(F.desc("df"), "topic").limit(shared_topic_limit(documents))


def assign_topics(topics: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each document: primary topic, memberships, confidence, status.

    A topic scores df / (rank + 1); the best is primary, others within 55 % of it
    are memberships. With more than six documents, topics of a single document go.
    A document is unclassified if nothing is left for it.
    """
    total = documents.count()
    shared = materialize(shared_topics(topics, total), "shared")  # 12 rows at most
    met = topics.join(F.broadcast(shared), "topic").withColumn("score", F.col("df") / (F.col("rank") + 1))
    each = met.groupBy("path").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("topic").alias("t"))).alias("c"), F.max(F.struct("score", "df", (-F.col("rank")).alias("r"), "topic")).alias("top"))
    ranked = F.array_sort("c")
    best = F.col("top.score")
    near = F.slice(F.transform(F.filter(ranked, lambda x: -x["s"] >= best * 0.55), lambda x: x["t"]), 1, 3)
    memberships = F.when(F.array_contains(near, F.col("top.topic")), near).otherwise(F.concat(F.array("top.topic"), near))
    second = F.when(F.size("c") > 1, -F.get(ranked, F.lit(1))["s"])
    margin = F.when(second.isNull(), 1.0).otherwise((best - second) / F.greatest(F.lit(1.0), best))
    placed = materialize(each.select("path", F.col("top.topic").alias("primary_topic"), memberships.alias("memberships"), F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.45), 0.55 + 0.35 * margin)), 3).alias("confidence")), "placed")
    if total > 6:
        lone = placed.select(F.explode("memberships").alias("t")).groupBy("t").count().filter("count = 1").agg(F.collect_list("t").alias("lone"))  # of 12 topics
        left = F.filter("memberships", lambda t: ~F.array_contains(F.col("lone"), t))
        placed = placed.crossJoin(F.broadcast(lone)).withColumn("memberships", left).filter(F.size("memberships") > 0)
        placed = placed.withColumn("primary_topic", F.when(F.array_contains("memberships", F.col("primary_topic")), F.col("primary_topic")).otherwise(F.get("memberships", F.lit(0)))).drop("lone")
    out = documents.select("path").join(placed, "path", "left")
    return out.select("path", "primary_topic", F.coalesce(F.array_join("memberships", "|"), F.lit("")).alias("memberships"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("primary_topic").isNull(), "unclassified").otherwise("classified").alias("status"))


def labelled(groups: DataFrame, topics: DataFrame) -> DataFrame:
    """groups: topic, path. topic, label: the topic and up to two words that its documents have in common."""
    words = groups.select(F.col("topic").alias("group"), "path").join(topics.select("path", "rank", "topic"), "path").filter(F.col("topic") != F.col("group"))
    common = words.groupBy("group", "topic").agg(F.count("*").alias("n"), F.min(F.struct("path", "rank")).alias("first")).filter("n >= 2")
    two = first_rows(common, ["group"], [F.desc("n"), F.col("first")], 2)
    names = two.groupBy("group").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "topic"))).alias("w"))  # two words
    heads = groups.select(F.col("topic").alias("group")).distinct()
    return heads.join(names, "group", "left").select(F.col("group").alias("topic"), F.concat_ws(" / ", F.col("group"), F.transform("w", lambda x: x["topic"])).alias("label"))


def topic_clusters(topics: DataFrame, wide: DataFrame, limit: int = 20) -> DataFrame:
    """Documents that share a topic, the largest clusters first, equal member sets once.

    topics: the five topics of each document, wide: the ten. Member sets are held
    against each other by their size and hashes, never gathered.
    """
    sets = topics.groupBy("topic").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("path")).alias("h1"), F.sum(F.xxhash64(F.lit(7), "path").cast("decimal(38,0)")).alias("h2"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).filter("members >= 2")
    distinct = sets.groupBy("members", "h1", "h2").agg(F.min(F.struct("topic", "first_path", "last_path")).alias("x"))
    top = materialize(distinct.select("members", "x.*").orderBy(F.desc("members"), "topic").limit(limit), "clusters")
    place = F.row_number().over(W.orderBy(F.desc("members"), "topic"))  # ``limit`` rows
    numbered = top.withColumn("cluster_id", F.concat(F.lit("TOPIC-"), F.lpad(place.cast("string"), 4, "0")))
    inside = topics.select("topic", "path").join(F.broadcast(top.select("topic")), "topic", "left_semi")
    return numbered.join(labelled(inside, wide), "topic").select("cluster_id", "topic", "label", "members", "first_path", "last_path")


def mounts(topics: DataFrame, groups: DataFrame, members: DataFrame, most: int = 2) -> DataFrame:
    """Further groups for a document: those with two of its topics among their terms, in the order of the groups.

    topics: path, topic (twelve each). groups: node_id, position, terms (array). members: node_id, path.
    """
    vocabulary = groups.select("node_id", "position", F.explode(F.array_distinct("terms")).alias("topic"))
    met = topics.select("path", "topic").distinct().join(small(vocabulary), "topic").groupBy("path", "node_id", "position").agg(F.count("*").alias("overlap")).filter("overlap >= 2")
    new = met.join(members.select("node_id", "path"), ["node_id", "path"], "left_anti")
    return first_rows(new, ["path"], [F.col("position")], most).select("path", "node_id", "overlap")


def subtopics(groups: DataFrame, topics: DataFrame, most: int = 4) -> DataFrame:
    """Parts of each group (topic, path): by the most frequent terms, each document in the first part that fits.

    A term must be in two documents or more but not all, and still have two
    documents left when its turn comes; at most ``most`` parts and the rest. All
    groups take their next part together, so there are ``most`` rounds whatever
    their number.
    """
    inside = materialize(groups.join(topics.select("path", F.col("topic").alias("term")), "path").filter(F.col("term") != F.col("topic")), "inside")
    sizes = groups.groupBy("topic").agg(F.count("*").alias("size"))
    order = F.struct((-F.col("df")).alias("o"), F.col("term").alias("t"))
    terms = materialize(inside.groupBy("topic", "term").agg(F.count("*").alias("df")).join(sizes, "topic").filter("df >= 2 and df < size").select("topic", "term", order.alias("order")), "terms")
    left = inside.join(terms, ["topic", "term"]).withColumn("after", F.lit(None).cast(terms.schema["order"].dataType))
    found = groups.select("topic", "path", F.lit(None).cast("string").alias("part"), F.lit(None).cast("int").alias("place")).limit(0)
    for place in range(most):
        left = materialize(left, "left")
        turn = left.filter(F.col("after").isNull() | (F.col("order") > F.col("after"))).groupBy("topic", "term", "order").agg(F.count("*").alias("k")).filter("k >= 2").groupBy("topic").agg(F.min("order").alias("turn"))
        now = left.join(turn, "topic").filter(F.col("order") == F.col("turn")).select("topic", "path", F.col("term").alias("part"), F.lit(place).alias("place"))
        now = materialize(now, "part")
        if now.isEmpty():
            break
        found = found.unionByName(now)
        left = left.drop("after").join(now.select("topic", "path"), ["topic", "path"], "left_anti").join(turn.withColumnRenamed("turn", "after"), "topic")
    rest = groups.join(found.select("topic", "path"), ["topic", "path"], "left_anti").select("topic", "path", F.lit("(rest)").alias("part"), F.lit(most).alias("place"))
    return found.unionByName(rest)


def looks_structured(text: Column) -> Column:
    """Whether a text has records: it opens like JSON, or three of its first 50 lines have as many delimiters."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    json = F.substring(bare, 1, 1).isin("{", "[") & ((F.regexp_count(bare, F.lit('":')) >= 2) | (F.regexp_count(bare, F.lit("':")) >= 2))
    lines = F.slice(F.filter(F.split(bare, r"[\n\r]+"), lambda x: F.trim(x) != ""), 1, 50)

    def even(delimiter: str) -> Column:
        widths = F.filter(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit("")))), lambda n: n > 0)
        return F.exists(F.array_distinct(widths), lambda w: F.size(F.filter(widths, lambda x: x == w)) >= 3)

    return (bare != "") & (json | ((F.size(lines) >= 3) & (even(",") | even("\t") | even("|"))))


def document_roles(docs: DataFrame, headings: Column | None = None) -> DataFrame:
    """path, role, scores. docs: path, text, name."""
    head = F.lower(F.coalesce(headings if headings is not None else F.lit(""), F.lit("")))
    stem, body = F.lower(F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")), F.lower(F.coalesce("text", F.lit("")))

    def weight(words: list[str]) -> Column:
        out = F.lit(0)
        for w in words:
            out = out + F.when(F.contains(head, F.lit(w)) | F.contains(stem, F.lit(w)), 3).when(F.contains(body, F.lit(w)), 1).otherwise(0)
        return out

    marked = docs.withColumns({"structured": looks_structured(F.coalesce("text", F.lit(""))), "requirement": weight(REQUIREMENT), "weak": weight(WEAK_REQUIREMENT), "research": weight(RESEARCH), "data": weight(DATA)})
    total = F.col("requirement") + F.least(F.lit(2), F.col("weak"))
    data = F.col("data") + F.when(F.col("structured"), 5).otherwise(0)
    role = (
        F.when(F.trim(F.concat_ws(" ", stem, head, body)) == "", ROLES["unrecognised"])
        .when(F.contains(F.concat_ws(" ", stem, head, body), F.lit(OVERVIEW_MARK)), ROLES["overview"])
        .when(F.col("structured") | (data >= 5), ROLES["data"])
        .when((F.col("research") >= 4) & (F.col("research") >= total), ROLES["research"])
        .when((F.col("requirement") >= 3) & (total >= F.col("research") + 2), ROLES["requirement"])
        .otherwise(ROLES["general"])
    )
    return marked.select("path", role.alias("role"), total.alias("requirement_score"), F.col("research").alias("research_score"), data.alias("data_score"))
