"""Profiles of tables: kinds, statistics, outliers, histograms, values, quality, and answers from them.

All figures come from one grouped table, ``cell_counts``: how often each value
occurs in each column. A column of few values is small after the partial
aggregate, and a column of a billion distinct values is spread by value, so that
nothing needs a column in one task. Order statistics are read from running sums
over the values in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import ENTITY, SENSITIVE, date, kind, missing, named_like, number, trimmed
from ..storage import materialize, running_sum, small
from .inventory import first_rows

# Words that name an operation, first match wins.
OPERATIONS = [
    ("sum", ["合计", "总和", "总计", "总额", "累计", "sum", "total"]),
    ("average", ["平均", "均值", "average", "avg"]),
    ("max", ["最大", "最高", "峰值", "max"]),
    ("min", ["最小", "最低", "min"]),
    ("count", ["多少", "数量", "几条", "记录数", "count", "多少个"]),
]


def _cell(position: int, name: str, kind_of: str) -> Column:
    """A cell by its type: whole, real, time or text (trimmed); the others are null."""
    x = F.col(f"`{name}`")
    whole, real, time = kind_of in ("tinyint", "smallint", "int", "bigint"), kind_of in ("float", "double"), kind_of in ("date", "timestamp", "timestamp_ntz")
    return F.struct(
        F.lit(position).alias("position"),
        (x if whole else F.lit(None)).cast("long").alias("whole"),
        (x if real else F.lit(None)).cast("double").alias("real"),
        (x if time else F.lit(None)).cast("timestamp_ntz").alias("time"),
        (F.lit(None) if whole or real or time else trimmed(x.cast("string"))).cast("string").alias("text"),
    )


def cell_counts(table: DataFrame, row_id: Column) -> DataFrame:
    """column, position, value (trimmed text or null), n, first_row, and the value's kind, number and date.

    Numbers and times are grouped as such and only written as text once for each
    distinct value; cells of other types are read as text. row_id: best a number,
    so that Spark groups by hash.
    """
    cells = F.explode(F.array(*(_cell(i, c, k) for i, (c, k) in enumerate(table.dtypes))))
    grouped = table.select(row_id.alias("row"), cells.alias("x")).groupBy("x.position", "x.whole", "x.real", "x.time", "x.text").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))
    finite = F.col("real").isNotNull() & ~F.isnan("real") & (F.abs("real") != float("inf"))
    text_of = F.when(F.col("time").isNotNull(), F.col("time").cast("string")).otherwise(F.coalesce(F.col("whole").cast("string"), F.col("real").cast("string"), F.col("text")))
    named = F.element_at(F.array(*(F.lit(c) for c in table.columns)), F.col("position") + 1)
    counted = grouped.select(named.alias("column"), "position", text_of.alias("value"), "n", "first_row", "whole", "real", "time", finite.alias("finite"))
    v, plain = F.col("value"), F.col("whole").isNull() & F.col("time").isNull() & ~F.col("finite")
    return materialize(
        counted.select(
            "column", "position", "value", "n", "first_row",
            F.when(F.col("time").isNotNull(), "datetime").when(~plain, "number").otherwise(kind(v)).alias("kind"),
            F.when(F.col("whole").isNotNull(), F.col("whole").cast("double")).when(F.col("finite"), F.col("real")).when(plain, number(v)).alias("number"),
            F.when(F.col("time").isNotNull(), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")).when(plain & ~missing(v), date(v)).alias("date"),
        ),
        "cells",
    )


def _numbers(cells: DataFrame) -> DataFrame:
    return cells.filter("number is not null").groupBy("column", "number").agg(F.sum("n").alias("n"))


def order_statistics(cells: DataFrame) -> DataFrame:
    """column, first_quartile, median, third_quartile: the elements at n/4, n/2 and 3n/4 of the sorted numbers."""
    numbers = _numbers(cells)
    totals = numbers.groupBy("column").agg(F.sum("n").alias("total"))
    before = totals.select("column", "total", (F.sum("total").over(W.orderBy("column")) - F.col("total")).alias("before"))  # a row for each column
    placed = running_sum(numbers, ["column", "number"], F.col("n"), "upto").join(F.broadcast(before), "column")
    last, first = F.col("upto") - F.col("before"), F.col("upto") - F.col("before") - F.col("n")
    at = lambda place: F.max(F.when((first <= place) & (place < last), F.col("number")))
    n = F.col("total")
    whole = lambda x: F.floor(x)
    return placed.groupBy("column").agg(at(whole(n / 4)).alias("first_quartile"), at(whole(n / 2)).alias("median"), at(whole(n * 3 / 4)).alias("third_quartile"))


def column_kinds(cells: DataFrame) -> DataFrame:
    """column, inferred_type: the most frequent kind of its cells, the first seen among equals."""
    kinds = cells.groupBy("column", "kind").agg(F.sum("n").alias("k"), F.min("first_row").alias("f"))
    return kinds.groupBy("column").agg(F.min_by("kind", F.struct(-F.col("k"), "f", "kind")).alias("inferred_type"))


def recommended_questions(columns: DataFrame) -> DataFrame:
    """What is worth asking of each table: source, place, question, columns (in the table's order).

    columns: source, column, position, inferred_type. A question is asked if a column fits it.
    """
    told = named_like(F.col("column"), ENTITY)
    fits = [("trend_over_time", F.col("inferred_type") == "datetime"), ("notable_numbers", F.col("inferred_type") == "number"), *((f"compare_by_{c}", F.array_contains(told, c)) for c in ENTITY)]
    asked = F.array(*(F.when(fit, F.struct(F.lit(i).cast("long").alias("place"), F.lit(name).alias("question"))) for i, (name, fit) in enumerate(fits, 1)))
    each = columns.withColumn("q", F.explode(F.filter(asked, lambda x: x.isNotNull()))).groupBy("source", "q").agg(F.array_sort(F.collect_list(F.struct("position", "column"))).alias("c"))
    return each.select("source", "q.place", "q.question", F.array_join(F.transform("c", lambda x: x["column"]), "|").alias("columns"))


def column_profile(cells: DataFrame, row_count: int) -> DataFrame:
    """One row for each column. row_count: rows of the table."""
    inferred = column_kinds(cells)
    known = ~missing(F.col("value"))
    x, n = F.col("number"), F.col("n")
    base = cells.groupBy("column", "position").agg(
        F.sum(F.when(known, 0).otherwise(n)).alias("missing_count"),
        F.count_if(known).alias("unique_count"),
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(f"{k}_cells") for k in ("number", "datetime", "text")),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.sum(x * n).alias("sum"),
        F.coalesce(F.sum(F.when(x.isNotNull(), n)), F.lit(0)).alias("count"),
        F.min("date").alias("min_datetime"),
        F.max("date").alias("max_datetime"),
    )
    ranks = order_statistics(cells)
    spread = (F.col("third_quartile") - F.col("first_quartile")) * 1.5
    out = _numbers(cells).join(F.broadcast(ranks), "column").groupBy("column").agg(F.sum(F.when((x < F.col("first_quartile") - spread) | (x > F.col("third_quartile") + spread), n).otherwise(0)).alias("outliers"))
    profile = base.join(inferred, "column").join(ranks, "column", "left").join(out, "column", "left")
    return profile.select(
        "column", "position", "inferred_type", "missing_count",
        F.round(F.col("missing_count") / F.lit(max(1, row_count)), 6).alias("missing_ratio"),
        "unique_count", "number_cells", "datetime_cells", "text_cells", "min", "max",
        F.round("sum", 6).alias("sum"), "count",
        F.round(F.col("sum") / F.nullif("count", F.lit(0)), 6).alias("mean"),
        "median",
        F.when(F.col("count") >= 4, F.col("outliers")).alias("outlier_count"),
        "min_datetime", "max_datetime",
        F.array_join(named_like(F.col("column"), SENSITIVE), "|").alias("sensitive_categories"),
        F.array_join(named_like(F.col("column"), ENTITY), "|").alias("entity_categories"),
    )


def histogram(cells: DataFrame, buckets: int = 5) -> DataFrame:
    """column, bucket, n for columns of at least as many numbers as buckets; empty buckets are left out."""
    numbers = _numbers(cells)
    ends = numbers.groupBy("column").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.sum("n").alias("total")).filter(F.col("total") >= buckets)
    width = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("hi") - F.col("lo")) / float(buckets))
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col("number") - F.col("lo")) / width)).cast("int") + 1
    return numbers.join(F.broadcast(ends), "column").groupBy("column", bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def top_values(cells: DataFrame, columns: DataFrame | None = None, k: int = 20) -> DataFrame:
    """The k most frequent values of each column (first seen first among equals); columns: which (column)."""
    known = cells.filter(~missing(F.col("value")))
    if columns is not None:
        known = known.join(F.broadcast(columns.select("column")), "column", "left_semi")
    return first_rows(known.select("column", "value", "n", "first_row"), ["column"], [F.desc("n"), F.col("first_row"), F.col("value")], k)


def sample_values(cells: DataFrame, k: int = 20) -> DataFrame:
    """The first k distinct values of each column."""
    known = cells.filter(~missing(F.col("value"))).select("column", "value", "first_row")
    return known.withColumn("place", F.row_number().over(W.partitionBy("column").orderBy("first_row", "value"))).filter(F.col("place") <= k).select("column", "value", "place")


def entity_values(cells: DataFrame, k: int = 20) -> DataFrame:
    """Values pooled over the columns of a category: category, value, n; the k most frequent."""
    known = cells.filter(~missing(F.col("value"))).withColumn("category", F.explode(named_like(F.col("column"), ENTITY)))
    pooled = known.groupBy("category", "value").agg(F.sum("n").alias("n"))
    return first_rows(pooled, ["category"], [F.desc("n"), F.col("value")], k)


def quality_score(missing_cells: Column, unique_columns: Column, column_count: Column, row_count: Column, penalty: Column) -> Column:
    """Of a hundred points 70 for cells that are there and 30 for columns of mostly distinct values, less a share for repeated rows."""
    complete = F.greatest(F.lit(0.0), 1 - missing_cells / F.greatest(F.lit(1.0), column_count * row_count.cast("double")))
    score = (complete * 70 + unique_columns / F.greatest(column_count, F.lit(1)) * 30) * (1 - penalty)
    return F.when((row_count == 0) | (column_count == 0), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2))


def listed_columns(cond: Column) -> Column:
    """Names of the columns that meet the condition, in the table's order."""
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("position", "column")))), lambda x: x["column"]), "|"), F.lit(""))


def value_level(score: Column, row_count: Column) -> Column:
    return F.when((score >= 80) & (row_count >= 10), "high").when(score >= 50, "medium").otherwise("needs_work")


def table_profile(columns: DataFrame, row_count: int, duplicates: int, *, truncated: bool = False) -> DataFrame:
    """One row: quality score and level, lists of columns by kind."""
    penalty = min(0.25, duplicates / max(1, row_count))
    one = columns.agg(
        F.count("*").alias("column_count"),
        F.coalesce(F.sum("missing_count"), F.lit(0)).alias("missing"),
        F.count_if(F.col("unique_count") >= max(1.0, row_count * 0.9)).alias("unique_columns"),
        listed_columns(F.col("missing_count") > 0).alias("missing_columns"),
        listed_columns(F.col("inferred_type") == "number").alias("numeric_columns"),
        listed_columns(F.col("inferred_type") == "datetime").alias("temporal_columns"),
        listed_columns(F.col("sensitive_categories") != "").alias("sensitive_columns"),
    )
    named = one.withColumn("quality_score", quality_score(F.col("missing"), F.col("unique_columns"), F.col("column_count"), F.lit(row_count), F.lit(penalty)))
    level = value_level(F.col("quality_score"), F.lit(row_count))
    return named.select(F.lit(row_count).cast("long").alias("row_count"), "column_count", F.lit(duplicates).cast("long").alias("duplicate_row_count"), "quality_score", level.alias("value_level"), F.lit(not truncated).alias("complete"), "missing_columns", "numeric_columns", "temporal_columns", "sensitive_columns")


def overview(tables: DataFrame) -> DataFrame:
    """One row over several tables (source and the columns of table_profile)."""
    return tables.agg(F.count("*").alias("profiled_tables"), F.sum("row_count").alias("total_rows"), F.round(F.avg("quality_score"), 2).alias("average_quality_score"), F.sum("duplicate_row_count").alias("duplicate_rows"), F.count_if(F.col("sensitive_columns") != "").alias("tables_with_sensitive_columns"))


def name_score(question: Column, column: Column) -> Column:
    """How much of a column's name stands in a question: ten for all of it, four for each part, two for each word."""
    pieces = F.filter(F.split(column, r"[_\s-]+"), lambda t: F.length(t) >= 2)
    words = F.regexp_extract_all(column, F.lit(r"[A-Za-z0-9_\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    named = lambda t: F.contains(F.lower(question), F.lower(t))
    return F.when(named(column), 10).otherwise(0) + 4 * F.size(F.filter(pieces, named)) + 2 * F.size(F.filter(words, named))


def figures_asked(questions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """What ``answer`` needs of the tables: figures of the columns that a question names, and which others are numbers.

    Names are looked at first. A named column of numbers is summed up in one pass
    with the table's others; one of another type goes through ``cell_counts``. A
    column that nobody names is known by its type, and its cells are only looked at
    where a table's types leave it open whether it has numbers at all.
    """
    spark = questions.sparkSession
    names = spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns], "source string, column string")
    asked = {(r["source"], r["column"]) for r in names.join(F.broadcast(questions.select("question")), name_score(F.col("question"), F.col("column")) > 0).select("source", "column").distinct().collect()}  # names of columns
    numeric = {t: [c for c, k in df.dtypes if k.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")] for t, df in tables.items()}
    enough = sum(map(len, numeric.values())) > 1
    out, kinds = None, "inferred_type string, min double, max double, sum double, count long, mean double"
    for source, df in tables.items():
        plain, told = [c for c in numeric[source] if (source, c) in asked], [c for c in df.columns if c not in numeric[source] and ((source, c) in asked or not enough)]
        x = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")) & (F.abs(F.col(f"`{c}`").cast("double")) != float("inf")), F.col(f"`{c}`").cast("double"))
        each = [F.struct(F.lit(c).alias("column"), F.when(F.count(x(c)) > 0, "number").otherwise("missing").alias("inferred_type"), F.min(x(c)).alias("min"), F.max(x(c)).alias("max"), F.round(F.sum(x(c)), 6).alias("sum"), F.count(x(c)).alias("count"), F.round(F.avg(x(c)), 6).alias("mean")) for c in plain]
        whole = df.agg(F.count("*").alias("row_count"), F.array(*each).alias("each")) if each else df.agg(F.count("*").alias("row_count")).withColumn("each", F.array().cast(f"array<struct<column:string,{kinds.replace(' ', ':').replace(',:', ',')}>>"))
        whole = materialize(whole, "figures")
        found = whole.select("row_count", F.explode_outer("each").alias("x")).select("row_count", "x.*")
        rest = [(c,) for c in numeric[source] if c not in plain]
        if rest:
            found = found.unionByName(spark.createDataFrame(rest, "column string").join(F.broadcast(whole.select("row_count")), F.lit(True)).withColumn("inferred_type", F.lit("number")), allowMissingColumns=True)
        if told:
            cells = cell_counts(df.select(*told), F.lit(0).cast("long"))
            sums = cells.groupBy("column").agg(F.min("number").alias("min"), F.max("number").alias("max"), F.round(F.sum(F.col("number") * F.col("n")), 6).alias("sum"), F.coalesce(F.sum(F.when(F.col("number").isNotNull(), F.col("n"))), F.lit(0)).alias("count"))
            sums = sums.withColumn("mean", F.round(F.col("sum") / F.nullif("count", F.lit(0)), 6)).join(column_kinds(cells), "column")
            found = found.unionByName(sums.join(F.broadcast(whole.select("row_count")), F.lit(True)), allowMissingColumns=True)
        one = found.withColumns({"source": F.lit(source), "complete": F.lit(True)})
        out = one if out is None else out.unionByName(one)
    return out


def answer(questions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Numbers for questions such as "total of amount", read from column profiles.

    questions: question_id, question. profiles: source, row_count, complete and the
    columns of column_profile. Each question is held against the numeric columns by
    their names; it is refused without an operation, or if no name fits and there
    are several columns. Both tables are small: questions are asked by people.
    """
    q = F.lower("question")
    operation = F.lit(None).cast("string")
    for name, words in reversed(OPERATIONS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(q, F.lit(w))
        operation = F.when(hit, name).otherwise(operation)
    numeric = profiles.filter("inferred_type = 'number'")
    score = name_score(F.col("question"), F.col("column"))
    met = questions.withColumn("operation", operation).join(small(materialize(numeric, "numeric-columns"), 10_000), F.lit(True), "left").withColumn("score", F.when(F.col("column").isNotNull(), score))
    w = W.partitionBy("question_id")
    best = met.withColumns({"candidates": F.count("column").over(w), "place": F.row_number().over(w.orderBy(F.desc("score"), "source", "column"))}).filter("place = 1")
    value = F.when(F.col("operation") == "sum", F.coalesce("sum", F.round(F.col("mean") * F.col("count"), 6))).when(F.col("operation") == "average", F.col("mean")).when(F.col("operation") == "max", F.col("max")).when(F.col("operation") == "min", F.col("min")).otherwise(F.col("count").cast("double"))
    rows = F.broadcast(profiles.select("source", "row_count", "complete").distinct().agg(F.coalesce(F.sum("row_count"), F.lit(0)).cast("double").alias("all_rows"), F.count_if(~F.col("complete")).alias("partial_profiles")))
    status = F.when(F.col("operation").isNull(), "unsupported_operation").when((F.col("candidates") == 0) & (F.col("operation") == "count"), "answered").when(F.col("candidates") == 0, "no_numeric_column").when((F.col("score") <= 0) & (F.col("candidates") > 1), "no_column_named").otherwise("answered")
    out = best.join(rows, F.lit(True)).withColumn("status", status)
    told = F.col("status") == "answered"
    by_column = told & (F.col("candidates") > 0)
    return out.select(
        "question_id", "operation", "status",
        F.when(by_column, F.col("source")).alias("source"),
        F.when(by_column, F.col("column")).alias("column"),
        F.when(by_column, value).when(told, F.col("all_rows")).alias("value"),
        F.when(told & (F.col("partial_profiles") == 0) & ((F.col("score") >= 10) | (F.col("candidates") == 0)), "high").when(told, "medium").alias("confidence"),
    )


def records(spark: SparkSession, lines: DataFrame, column: str) -> DataFrame:
    """JSON objects as rows: row, key, value (nested values as JSON text); broken lines have no keys and parsed is false."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return lines.withColumn("__map", parsed).select(*lines.columns, F.col("__map").isNotNull().alias("parsed"), F.explode_outer("__map").alias("key", "value"))
