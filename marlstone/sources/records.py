"""Tables in text files, all cells as text: CSV, TSV, JSON lines, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def column_names(header: list[str | None]) -> list[str]:
    """Blank names become column_N; repeated ones get a number."""
    seen: dict[str, int] = {}
    out = []
    for i, raw in enumerate(header, 1):
        name = (raw or "").strip() or f"column_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def read_delimited(spark: SparkSession, path: str, *, separator: str | None = None, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """Short rows miss their last cells, and cells beyond the header are dropped. Tab for .tsv."""
    separator = separator or ("\t" if path.lower().rstrip("/").endswith(".tsv") else ",")
    plain = spark.read.options(sep=separator, header=False, inferSchema=False, mode="PERMISSIVE", multiLine=multi_line, encoding=encoding, escape='"')
    header = plain.csv(path).limit(1).collect()
    if not header:
        return spark.createDataFrame([], "column_1 string")
    names = column_names(list(header[0]))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return plain.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no order is the file's; record is a map of texts, null where the line is no object. Blank lines are left out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", "map<string,string>").alias("record"), F.length("value").alias("chars"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document: an array of objects, or one object as one row; nested values as JSON text."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    rows = F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<map<string,string>>")).otherwise(F.array(F.from_json("value", "map<string,string>")))
    return whole.select(F.explode(rows).alias("record"))


def as_table(records: DataFrame) -> DataFrame:
    """Rows of maps as a table; the columns are all keys, by name."""
    keys = [r["key"] for r in records.select(F.explode(F.map_keys("record")).alias("key")).distinct().orderBy("key").collect()]  # one for each column
    return records.filter("record is not null").select(*(F.col("record").getItem(k).alias(k) for k in keys))


def parse_errors(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.count_if(F.col("record").isNull()).alias("parse_errors"))


def bounded(table: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """The first rows, and whether there were more."""
    return table.limit(max_rows), table.limit(max_rows + 1).count() > max_rows
