"""Queries over the structured tables: profiles and what is read from them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import ENTITY, SENSITIVE, named_like
from ..operators import duplicates, file_profile, profile
from ..sources.bounded import read_bounded
from ..storage import fresh_folder, materialize
from .common import Query, table

#: Tables and their keys, which give the order of rows.
KEYS = {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey"), "orders": ("o_orderkey",), "customer": ("c_custkey",), "part": ("p_partkey",), "supplier": ("s_suppkey",), "events": ("event_id",)}
QUESTIONS = ["total o_totalprice", "average l_quantity", "max l_extendedprice", "min c_acctbal", "count of orders", "how nice is it", "sum of everything", "平均 s_acctbal"]


def cells(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The first key gives the order of rows."""
    return profile.cell_counts(table(spark, sf_dir, name), F.col(KEYS[name][0]))


def _column_profile(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, name).count()
        found = profile.column_profile(cells(spark, sf_dir, name), rows)
        # sums of many doubles differ in their last digits by the order of adding
        return found.withColumns({"position": F.col("position").cast("long"), "sum": F.round("sum", 2), "mean": F.round("mean", 4)})

    return query


def _top_values(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = cells(spark, sf_dir, name)
        kinds = profile.column_profile(own, 1).filter("inferred_type = 'text'")
        return profile.top_values(own, kinds).select("column", "value", "n")

    return query


def _histogram(name: str) -> Query:
    return lambda spark, sf_dir: profile.histogram(cells(spark, sf_dir, name)).withColumn("bucket", F.col("bucket").cast("long"))


def _samples(name: str) -> Query:
    return lambda spark, sf_dir: profile.sample_values(cells(spark, sf_dir, name)).withColumn("place", F.col("place").cast("long"))


def _table_profile(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    counts = duplicates.duplicate_rows(table(spark, sf_dir, name)).first()
    columns = profile.column_profile(cells(spark, sf_dir, name), counts["row_count"])
    return profile.table_profile(columns, counts["row_count"], counts["duplicate_row_count"]).withColumn("source", F.lit(name))


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [duplicates.duplicate_rows(table(spark, sf_dir, n)).withColumn("source", F.lit(n)) for n in ("events", "lineitem")]
    # without their key, so that rows do repeat
    each.append(duplicates.duplicate_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")).withColumn("source", F.lit("orders without key")))
    return reduce(DataFrame.unionByName, each)


def table_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_table_profile(spark, sf_dir, n) for n in KEYS])


def structured_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.overview(table_quality_score(spark, sf_dir))


def recommended_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = []
    for name in KEYS:
        own = cells(spark, sf_dir, name)
        each.append(profile.column_kinds(own).join(own.groupBy("column").agg(F.min("position").alias("position")), "column").withColumn("source", F.lit(name)))
    return profile.recommended_questions(reduce(DataFrame.unionByName, each))


def sensitive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [(n, c) for n in KEYS for c in table(spark, sf_dir, n).columns]
    rows = spark.createDataFrame(names, "source string, column string")
    return rows.select("source", "column", F.array_join(named_like(F.col("column"), SENSITIVE), "|").alias("sensitive"), F.array_join(named_like(F.col("column"), ENTITY), "|").alias("entity"))


def entity_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all columns, of all tables, whose names tell of persons, places or events."""
    parts = []
    for name in KEYS:
        own = table(spark, sf_dir, name)
        told = [c for c in own.columns if any(re.search(p, c, re.IGNORECASE) for p in ENTITY.values())]
        if told:
            parts.append(profile.cell_counts(own.select(*told), F.lit(0).cast("long")))
    return profile.entity_values(reduce(DataFrame.unionByName, parts))


def json_props_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the events' JSON as columns: how many rows have them, distinct values, kinds."""
    found = profile.records(spark, table(spark, sf_dir, "events").select("event_id", "props"), "props")
    from ..functions.cells import kind, number, trimmed

    v = trimmed(F.col("value"))
    each = found.filter("key is not null").groupBy("key").agg(F.count("*").alias("rows"), F.count_distinct(v).alias("unique_count"), F.count_if(kind(v) == "number").alias("number_cells"), F.min(number(v)).alias("min"), F.max(number(v)).alias("max"))
    return each


def structured_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "question_id long, question string")
    profiles = materialize(profile.figures_asked(asked, {n: table(spark, sf_dir, n) for n in KEYS}), "profiles")
    return profile.answer(asked, profiles).withColumn("value", F.round("value", 2))


def _segment_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as one file of JSON lines for each market segment, read back as files of an unknown kind; negative balances are left out of their records."""
    folder = fresh_folder(spark, "segments")
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.col("c_mktsegment").alias("segment"))
    own.repartition("segment").sortWithinPartitions("segment", "c_custkey").write.partitionBy("segment").option("compression", "none").json(folder)
    found = read_bounded(spark, folder, max_rows=10_000_000, lines=".json")
    return tuple(x.withColumn("source", F.url_decode(F.regexp_extract("path", "segment=([^/]*)", 1))) for x in file_profile.profile_files(found))


def bounded_file_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, _ = _segment_files(spark, sf_dir)
    return columns.select("source", "column", "position", "inferred_type", "missing_count", "missing_ratio", "unique_count", "number_cells", "text_cells", "min", "max", F.round("sum", 2).alias("sum"), "count", F.round("mean", 4).alias("mean"), "median", "outlier_count", "sensitive_categories")


def bounded_file_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _segment_files(spark, sf_dir)
    return files.select("source", "status", "encoding", "row_count", "column_count", "duplicate_row_count", "quality_score", "value_level", "complete", "missing_columns", "numeric_columns", "sensitive_columns")


QUERIES = {
    **{f"column_profile_{n}": _column_profile(n) for n in KEYS},
    **{f"column_top_values_{n}": _top_values(n) for n in ("orders", "customer", "part", "events")},
    **{f"column_histogram_{n}": _histogram(n) for n in ("lineitem", "orders", "events")},
    "column_samples_customer": _samples("customer"),
    **{f.__name__: f for f in (duplicate_rows, table_quality_score, structured_overview, recommended_questions, sensitive_columns, entity_values, json_props_profile, structured_qa, bounded_file_columns, bounded_file_profiles)},
}

COLUMNS = {
    "lineitem": {"l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n", "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "d"},
    "orders": {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "t", "o_totalprice": "n", "o_orderdate": "d", "o_orderpriority": "t"},
    "customer": {"c_custkey": "n", "c_name": "t", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "t"},
    "part": {"p_partkey": "n", "p_name": "t", "p_brand": "t", "p_type": "t", "p_size": "n", "p_retailprice": "n"},
    "supplier": {"s_suppkey": "n", "s_name": "t", "s_nationkey": "n", "s_acctbal": "n"},
    "events": {"event_id": "n", "ts": "d", "user_id": "n", "event_type": "t", "value": "n", "props": "t"},
}
CATEGORIES = r"CASE WHEN regexp_matches(c, '(?i)email|e-mail') THEN 'email' WHEN regexp_matches(c, '(?i)phone|mobile|tel') THEN 'phone' WHEN regexp_matches(c, '(?i)(^|[_ -])(id)($|[_ -])') THEN 'id' WHEN regexp_matches(c, '(?i)name') THEN 'name' WHEN regexp_matches(c, '(?i)address') THEN 'address' ELSE '' END"
ENTITIES = r"CASE WHEN regexp_matches(c, '(?i)name') THEN 'person' WHEN regexp_matches(c, '(?i)address') THEN 'location' WHEN regexp_matches(c, '(?i)event|category') THEN 'event' ELSE '' END"


def _profile_rows(name: str) -> str:
    """A SELECT for each column, by its real type."""
    out = []
    for i, (c, k) in enumerate(COLUMNS[name].items()):
        kind = {"n": "number", "d": "datetime", "t": "text"}[k]
        cells = [f"count({c}) FILTER ({c} IS NOT NULL) AS {x}_cells" if x == kind else f"0 AS {x}_cells" for x in ("number", "datetime", "text")]
        if k == "n":
            figures = f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(sum({c}::DOUBLE), 2) AS sum, count({c}) AS count, round(avg({c}::DOUBLE), 4) AS mean, (SELECT v FROM {name}_{c} WHERE r = n // 2 + 1)::DOUBLE AS median, (SELECT count(*) FROM {name}_{c}, (SELECT max(v) FILTER (r = n // 4 + 1) AS q1, max(v) FILTER (r = 3 * n // 4 + 1) AS q3 FROM {name}_{c}) WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count"
        else:
            figures = "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS sum, 0 AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::BIGINT AS outlier_count"
        dates = f"strftime(min({c}), '%Y-%m-%dT%H:%M:%S') AS min_datetime, strftime(max({c}), '%Y-%m-%dT%H:%M:%S') AS max_datetime" if k == "d" else "NULL::VARCHAR AS min_datetime, NULL::VARCHAR AS max_datetime"
        out.append(f"SELECT '{c}' AS c, {i} AS position, '{kind}' AS inferred_type, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / count(*), 6) AS missing_ratio, count(DISTINCT {c}) AS unique_count, {', '.join(cells)}, {figures}, {dates} FROM {name}")
    return " UNION ALL ".join(out)


def _ranked(name: str) -> str:
    return ", ".join(f"{name}_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM {name} WHERE {c} IS NOT NULL)" for c, k in COLUMNS[name].items() if k == "n")


def _profile_sql(name: str) -> str:
    return f"WITH {_ranked(name)}, p AS ({_profile_rows(name)}) SELECT c AS \"column\", * EXCLUDE (c), {CATEGORIES} AS sensitive_categories, {ENTITIES} AS entity_categories FROM p"


def _order(name: str) -> str:
    return ", ".join(KEYS[name])


def _top_sql(name: str) -> str:
    each = [f"(SELECT '{c}' AS \"column\", v AS value, n FROM (SELECT {c} AS v, count(*) AS n, min(({_order(name)})) AS f FROM {name} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, f LIMIT 20)" for c, k in COLUMNS[name].items() if k == "t"]
    return " UNION ALL ".join(each)


def _histogram_sql(name: str) -> str:
    each = [f"SELECT '{c}' AS \"column\", least(4, floor(({c} - lo) / CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / 5.0::DOUBLE END))::BIGINT + 1 AS bucket, count(*) AS n FROM {name}, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {name}) WHERE {c} IS NOT NULL GROUP BY 2" for c, k in COLUMNS[name].items() if k == "n"]
    return " UNION ALL ".join(each)


def _samples_sql(name: str) -> str:
    each = [f"(SELECT '{c}' AS \"column\", v::VARCHAR AS value, row_number() OVER (ORDER BY f) AS place FROM (SELECT {c} AS v, min(({_order(name)})) AS f FROM {name} WHERE {c} IS NOT NULL GROUP BY 1) QUALIFY place <= 20)" for c in COLUMNS[name]]
    return " UNION ALL ".join(each)


def _quality_sql() -> str:
    each = []
    for name, columns in COLUMNS.items():
        missing = " + ".join(f"(count(*) - count({c}))" for c in columns)
        unique = " + ".join(f"(count(DISTINCT {c}) >= greatest(1.0, 0.9 * count(*)))::INT" for c in columns)
        lists = {"numeric_columns": "|".join(c for c, k in columns.items() if k == "n"), "temporal_columns": "|".join(c for c, k in columns.items() if k == "d")}
        named = "|".join(c for c in columns if "name" in c or c.endswith("_id"))
        gaps = " || ".join(f"CASE WHEN count(*) > count({c}) THEN '|{c}' ELSE '' END" for c in columns)
        each.append(f"SELECT '{name}' AS source, count(*) AS row_count, {len(columns)} AS column_count, ({missing}) AS m, ({unique}) AS u, substr({gaps}, 2) AS missing_columns, '{lists['numeric_columns']}' AS numeric_columns, '{lists['temporal_columns']}' AS temporal_columns, '{named}' AS sensitive_columns, (SELECT count(*) FROM {name}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_row_count FROM {name}")
    body = " UNION ALL ".join(each)
    return f"q AS (SELECT * EXCLUDE (m, u), round(((1 - m / (row_count * column_count)) * 70 + u / column_count * 30) * (1 - least(0.25, duplicate_row_count / row_count)), 2) AS quality_score, true AS complete FROM ({body})), lev AS (SELECT *, CASE WHEN quality_score >= 80 AND row_count >= 10 THEN 'high' WHEN quality_score >= 50 THEN 'medium' ELSE 'needs_work' END AS value_level FROM q)"


SEGMENT = "seg AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_mktsegment AS source FROM customer)"


def _segment_columns_sql() -> str:
    each = []
    for i, (c, k) in enumerate({"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number"}.items()):
        ranked = f"(SELECT source, {c}::DOUBLE AS v, row_number() OVER (PARTITION BY source ORDER BY {c}) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM seg WHERE {c} IS NOT NULL)"
        if k == "number":
            quartiles = f"(SELECT source, max(v) FILTER (r = n // 4) AS q1, max(v) FILTER (r = n // 2) AS median, max(v) FILTER (r = 3 * n // 4) AS q3 FROM {ranked} GROUP BY source)"
            figures = f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(sum({c}::DOUBLE), 2) AS sum, count({c}) AS count, round(avg({c}::DOUBLE), 4) AS mean, any_value(median) AS median, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count"
            source = f"seg JOIN {quartiles} USING (source)"
        else:
            figures, source = "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS sum, 0 AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::BIGINT AS outlier_count", "seg"
        each.append(f"SELECT source, '{c}' AS \"column\", {i}::BIGINT AS position, '{k}' AS inferred_type, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / count(*), 6) AS missing_ratio, count(DISTINCT {c}) AS unique_count, {f'count({c})' if k == 'number' else '0'} AS number_cells, {f'count({c})' if k == 'text' else '0'} AS text_cells, {figures}, '{'name' if 'name' in c else ''}' AS sensitive_categories FROM {source} GROUP BY source")
    return f"WITH {SEGMENT} " + " UNION ALL ".join(each)


SEGMENT_FILES = f"""WITH {SEGMENT}, m AS (
  SELECT source, count(*) AS row_count, count(*) - count(c_acctbal) AS gaps,
    (count(DISTINCT c_custkey) >= 0.9 * count(*))::INT + (count(DISTINCT c_name) >= 0.9 * count(*))::INT + (count(DISTINCT c_nationkey) >= 0.9 * count(*))::INT + (count(DISTINCT c_acctbal) >= 0.9 * count(*))::INT AS distinct_columns
  FROM seg GROUP BY source
), q AS (SELECT *, round((1 - gaps / (4 * row_count)) * 70 + distinct_columns / 4 * 30, 2) AS quality_score FROM m)
SELECT source, 'completed' AS status, 'utf-8' AS encoding, row_count, 4::BIGINT AS column_count, 0::BIGINT AS duplicate_row_count, quality_score,
  CASE WHEN quality_score >= 80 AND row_count >= 10 THEN 'high' WHEN quality_score >= 50 THEN 'medium' ELSE 'needs_work' END AS value_level, true AS complete,
  CASE WHEN gaps > 0 THEN 'c_acctbal' ELSE '' END AS missing_columns, 'c_custkey|c_nationkey|c_acctbal' AS numeric_columns, 'c_name' AS sensitive_columns FROM q"""

ORACLE_SQL = {
    "bounded_file_columns": _segment_columns_sql(),
    "bounded_file_profiles": SEGMENT_FILES,
    **{f"column_profile_{n}": _profile_sql(n) for n in KEYS},
    **{f"column_top_values_{n}": _top_sql(n) for n in ("orders", "customer", "part", "events")},
    **{f"column_histogram_{n}": _histogram_sql(n) for n in ("lineitem", "orders", "events")},
    "column_samples_customer": _samples_sql("customer"),
    "duplicate_rows": "SELECT count(*) AS row_count, count(*) - count(DISTINCT t) AS duplicate_row_count, 'events' AS source FROM events t UNION ALL SELECT count(*), count(*) - count(DISTINCT t), 'lineitem' FROM lineitem t UNION ALL SELECT count(*), count(*) - count(DISTINCT (o_custkey, o_orderstatus, o_orderpriority)), 'orders without key' FROM orders",
    "table_quality_score": f"WITH {_quality_sql()} SELECT * FROM lev",
    "structured_overview": f"WITH {_quality_sql()} SELECT count(*) AS profiled_tables, sum(row_count)::BIGINT AS total_rows, round(avg(quality_score), 2) AS average_quality_score, sum(duplicate_row_count)::BIGINT AS duplicate_rows, count(*) FILTER (sensitive_columns <> '') AS tables_with_sensitive_columns FROM lev",
    "recommended_questions": " UNION ALL ".join(
        f"SELECT source, {i}::BIGINT AS place, '{q}' AS question, string_agg(c, '|' ORDER BY i) AS columns FROM (VALUES {', '.join(f"('{n}', '{c}', {i}, '{k}')" for n, cs in COLUMNS.items() for i, (c, k) in enumerate(cs.items()))}) v(source, c, i, k) WHERE {where} GROUP BY source"
        for i, (q, where) in enumerate([("trend_over_time", "k = 'd'"), ("notable_numbers", "k = 'n'"), *((f"compare_by_{e}", f"{ENTITIES} = '{e}'") for e in ("person", "location", "event"))], 1)
    ),
    "sensitive_columns": f"SELECT source, c AS \"column\", {CATEGORIES} AS sensitive, {ENTITIES} AS entity FROM (VALUES {', '.join(f"('{n}', '{c}')" for n, cs in COLUMNS.items() for c in cs)}) v(source, c)",
    "entity_values": "SELECT category, value, n FROM (SELECT category, v AS value, count(*) AS n FROM (SELECT 'person' AS category, c_name AS v FROM customer UNION ALL SELECT 'person', s_name FROM supplier UNION ALL SELECT 'person', p_name FROM part UNION ALL SELECT 'event', event_type FROM events UNION ALL SELECT 'event', event_id::VARCHAR FROM events) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, value) <= 20",
    "json_props_profile": "SELECT key, count(*) AS rows, count(DISTINCT v) AS unique_count, count(TRY_CAST(v AS DOUBLE)) AS number_cells, min(TRY_CAST(v AS DOUBLE)) AS min, max(TRY_CAST(v AS DOUBLE)) AS max FROM (SELECT key, json_extract_string(props, '$.\"' || key || '\"') AS v FROM (SELECT props, unnest(json_keys(props)) AS key FROM events)) GROUP BY key",
    "structured_qa": """SELECT * FROM (
SELECT 0::BIGINT AS question_id, 'sum' AS operation, 'answered' AS status, 'orders' AS source, 'o_totalprice' AS "column", round(sum(o_totalprice), 2) AS value, 'high' AS confidence FROM orders
UNION ALL SELECT 1, 'average', 'answered', 'lineitem', 'l_quantity', round(avg(l_quantity), 2), 'high' FROM lineitem
UNION ALL SELECT 2, 'max', 'answered', 'lineitem', 'l_extendedprice', max(l_extendedprice), 'high' FROM lineitem
UNION ALL SELECT 3, 'min', 'answered', 'customer', 'c_acctbal', min(c_acctbal), 'high' FROM customer
UNION ALL SELECT 4, 'count', 'no_column_named', NULL, NULL, NULL, NULL UNION ALL SELECT 5, NULL, 'unsupported_operation', NULL, NULL, NULL, NULL UNION ALL SELECT 6, 'sum', 'no_column_named', NULL, NULL, NULL, NULL
UNION ALL SELECT 7, 'average', 'answered', 'supplier', 's_acctbal', round(avg(s_acctbal), 2), 'high' FROM supplier)""",
}
