"""How the driver's tables stand in for files: documents as text files, pages as HTML files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplicates, evidence, inventory
from ..storage import materialize

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, name, size, sha256, modified_at (unknown), text."""
    path = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), text.alias("text"))
    return docs.select("doc_id", "path", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.lit(None).cast("string").alias("modified_at"), "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows of documents and pages."""
    docs = documents(spark, sf_dir).select("path", "size")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"))
    return inventory.with_names(docs.unionByName(pages))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence corpus of the canonical documents, written once as all searches read it several times."""
    docs = duplicates.canonical_documents(documents(spark, sf_dir))
    return materialize(evidence.corpus(evidence.evidence_units(docs)), "units")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


# DuckDB texts that several queries share
SPACES = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
DOCS = "docs AS (SELECT doc_id, concat(coalesce(lang, ''), '/', coalesce(source, ''), '/', doc_id, '.txt') AS path, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS sha FROM documents)"
CANON = DOCS + ", canon AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY sha ORDER BY size DESC, path) = 1)"
HUMAN = "CASE WHEN {b} < 1024 THEN printf('%.1f B', {b}::DOUBLE) WHEN {b} < 1048576 THEN printf('%.1f KB', {b} / 1024.0::DOUBLE) WHEN {b} < 1073741824 THEN printf('%.1f MB', {b} / 1048576.0::DOUBLE) ELSE printf('%.1f GB', {b} / 1073741824.0::DOUBLE) END"
MARK = r"(\[第\s*[0-9]+\s*页(?:/张)?(?:\s*OCR)?\]|\[幻灯片\s*[0-9]+\]|\n#{1,6}\s+)"
FACT = "是|为|具有|通过|采用|支持|提供|实现|包括|导致|提升|降低|减少|增加|能够|可以|用于|依赖|需[要须]|应当|必须|表明|显示|发现|证明|说明|源于|结果|优势|特点|机制|原因|影响|风险|限制|缺陷|许可|安全|成本|性能"
QUANTITY = r"[0-9]+(\.[0-9]+)?\s*(%|％|万|亿|吨|元|天|次|例|倍|项|种)"


def chunks_sql(source: str) -> str:
    """Units of the rows of ``source``, with the gate."""
    return rf"""
parts AS (SELECT path, sha, string_split(regexp_replace(text, '{MARK}', chr(1) || '\1', 'g'), chr(1)) AS p FROM {source}),
sections AS (SELECT path, sha, unnest(p) AS raw, generate_subscripts(p, 1) AS sec FROM parts),
slices AS (SELECT path, sha, sec, i, trim(regexp_replace(substr(raw, i::INT + 1, 1200), '{SPACES}', ' ', 'g')) AS text FROM (SELECT *, unnest(range(0, greatest(length(raw), 1), 1200)) AS i FROM sections)),
chunks AS (SELECT path, sha, row_number() OVER (PARTITION BY path ORDER BY sec, i) AS seq, text FROM slices WHERE text <> ''),
named AS (SELECT *, 'E-' || sha[:10] || '-' || CASE WHEN seq < 100000 THEN lpad(seq::VARCHAR, 5, '0') ELSE seq::VARCHAR END AS evidence_id, regexp_replace(text, '^[ ：:;；。.]+|[ ：:;；。.]+$', '', 'g') AS bare FROM chunks),
judged AS (SELECT *, regexp_matches(bare, '{FACT}') AS f, regexp_matches(bare, '{QUANTITY}') AS q,
  CASE WHEN length(bare) < 6 THEN 'too_short' WHEN length(bare) < 24 AND NOT regexp_matches(bare, '{FACT}') THEN 'short_without_fact'
    WHEN right(bare, 1) IN ('?', '？') THEN 'question' WHEN length(bare) < 55 AND NOT regexp_matches(bare, '{FACT}') THEN 'topic_phrase' ELSE 'eligible' END AS reason FROM named),
corpus AS (SELECT * FROM judged WHERE reason = 'eligible' QUALIFY row_number() OVER (PARTITION BY path, text ORDER BY seq) = 1)"""


TOPIC_STOP = "('the', 'and', 'for', 'with', 'from', 'this', 'that', '研究', '分析', '报告', '文档', '文件', '资料', '进行', '一种', '基于', '相关', '情况', '数据', '方法')"


def topics_sql(source: str) -> str:
    """words, then topics (path, rank, topic, n) with every word of a text ranked."""
    return rf"""
words AS (SELECT path, lower(w) AS topic, i FROM (SELECT path, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM (SELECT path, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{{2,}}|[\x{{4e00}}-\x{{9fff}}]{{2,8}}') AS m FROM {source})) WHERE lower(w) NOT IN {TOPIC_STOP}),
topics AS (SELECT path, topic, n, row_number() OVER (PARTITION BY path ORDER BY n DESC, first) - 1 AS rank FROM (SELECT path, topic, count(*) AS n, min(i) AS first FROM words GROUP BY 1, 2))"""


SEARCH_TOKENS = r"list_filter(flatten(list_transform(regexp_extract_all(lower({text}), '[a-z][a-z0-9_.-]+|[\x{{4e00}}-\x{{9fff}}]{{2,}}'), lambda v: CASE WHEN regexp_matches(v, '^[a-z]') THEN [v] ELSE list_concat([v], list_transform(range(1, length(v)), lambda i: substr(v, i::INT, 2)), list_transform(range(1, length(v) - 1), lambda i: substr(v, i::INT, 3))) END)), lambda t: t <> '')"


def bm25_sql(units: str, queries: str) -> str:
    """scored: query_id, path, evidence_id, bm25."""
    return f"""
toks AS (SELECT path, evidence_id, {SEARCH_TOKENS.format(text="text")} AS t FROM {units}),
facts AS (SELECT count(*) AS n, avg(len(t)) AS a FROM toks),
tf AS (SELECT path, evidence_id, len AS l, term, count(*) AS tf FROM (SELECT path, evidence_id, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({SEARCH_TOKENS.format(text="query")}) AS term FROM {queries}) GROUP BY ALL),
scored AS (SELECT query_id, path, evidence_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS bm25 FROM qt JOIN df USING (term) JOIN tf USING (term), facts GROUP BY ALL)"""


RANKED = """
capped AS (SELECT * FROM fused WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, evidence_id) <= {per}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, evidence_id) AS rank FROM capped)
"""
