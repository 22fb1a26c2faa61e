"""The numbered queries of this subpackage and their DuckDB SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .cminhash import near_duplicates
from .common import table
from .decontam import decontaminate
from .kdshard import shard_documents
from .lattice import score_documents
from .linededup import dedup_lines
from .mixing import mix_sources
from .ordinal import grade_documents
from .perplexity import judge_documents
from .resample import resample
from .urltrees import Rule, judge_urls
from .variants import spelling_variants
from .warc import archive_pages

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    return score_documents(docs, tokenizer_file("piece_bpe_32k.model"))


def op2_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op5_ordinal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 neither, 2 of quality and not toxic."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    ratings = table(spark, sf_dir, "labels").filter("quality is not null or toxic is not null").select("doc_id", grade.alias("grade"))
    return grade_documents(table(spark, sf_dir, "documents"), ratings)


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("clean_text").cast("binary"), 256).alias("kept_sha256"))


def op9_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), with_ids=False)


def op10_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lattice_likelihood, op2_ngram_perplexity, op3_kd_shards, op4_url_trees, op5_ordinal_grades, op6_circulant_minhash, op7_warc_chunks, op8_line_dedup, op9_bpe_segment_tree, op10_aho_corasick, op11_spelling_variants, op12_importance_resample, op13_pivotal_mix)
}

#: CRC-32 in DuckDB: its table, and the checksum of a text's UTF-8 bytes.
CRC_TABLE = "crct AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"
UTF8 = "flatten(list_transform(string_split({0}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] WHEN ord(ch) < 2048 THEN [192 + (ord(ch) >> 6), 128 + (ord(ch) & 63)]::BIGINT[] WHEN ord(ch) < 65536 THEN [224 + (ord(ch) >> 12), 128 + ((ord(ch) >> 6) & 63), 128 + (ord(ch) & 63)]::BIGINT[] ELSE [240 + (ord(ch) >> 18), 128 + ((ord(ch) >> 12) & 63), 128 + ((ord(ch) >> 6) & 63), 128 + (ord(ch) & 63)]::BIGINT[] END))"


def _crc_sql(text: str) -> str:
    return f"xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], {UTF8.format(text)}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _features_sql(name: str, source: str, key: str) -> str:
    """Uses of each run of one to three words by text, and the bucket of each run."""
    return rf"""{name}w AS (SELECT {key} AS k, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {source}),
{name}f AS (SELECT k, f, count(*) AS n FROM (SELECT k, array_to_string(w[i:i + g - 1], ' ') AS f FROM (SELECT k, w, g, unnest(range(1, len(w) - g + 2)) AS i FROM {name}w, range(1, 4) r(g))) GROUP BY ALL)"""


ORACLE_SQL: dict[str, str] = {
    "op11_spelling_variants": rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM each, crct),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
dels AS (SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)),
shorter AS (SELECT DISTINCT dels.word AS long, w.word AS short FROM dels JOIN words w ON w.word = d),
near AS (SELECT a.word, b.word AS other FROM dels a JOIN dels b ON a.d = b.d AND a.k = b.k AND a.word <> b.word UNION SELECT long, short FROM shorter UNION SELECT short, long FROM shorter),
best AS (SELECT near.word, other, o.n AS m, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN words o ON o.word = other QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) = 1),
judged AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * words.n THEN other END AS form, CASE WHEN m >= 5 * words.n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM judged UNION ALL SELECT way.word, j.form FROM way JOIN judged j ON j.word = way.at WHERE j.form IS NOT NULL)
SELECT j.word, j.form, way.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN way ON way.word = j.word JOIN judged e ON e.word = way.at WHERE e.form IS NULL
""",
    "op12_importance_resample": rf"""
WITH {CRC_TABLE}, {_features_sql('d', 'documents', 'doc_id')}, {_features_sql('b', 'benchmark', 'item_id')},
buckets AS (SELECT f, {_crc_sql('f')} % 10000 AS b FROM (SELECT f FROM df UNION SELECT f FROM bf), crct),
s AS (SELECT b, sum(n)::BIGINT AS n FROM df JOIN buckets USING (f) GROUP BY 1), t AS (SELECT b, sum(n)::BIGINT AS n FROM bf JOIN buckets USING (f) GROUP BY 1),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gains AS (SELECT r.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM range(10000) r(b) LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b, totals),
weights AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM df JOIN buckets USING (f) JOIN gains USING (b) GROUP BY 1),
scored AS (SELECT k AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || k)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM dw LEFT JOIN weights USING (k)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT doc_id, rank FROM drawn WHERE rank <= 5 * n // 100) USING (doc_id)
""",
    "op6_circulant_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT x AS a, y AS b FROM edges UNION SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
""",
    "op7_warc_chunks": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
""",
    "op8_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, c.first IS NOT NULL AND k.doc_id <> c.first AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op10_aho_corasick": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""",
}
