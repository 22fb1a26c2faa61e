"""Written tables that cut lineage, and row numbers and running sums over a whole table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_ending: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-marlstone-")
    return _own["dir"]


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A folder below the shared one that this run alone uses; all of them go when the application ends."""
    root = f"{shared_dir(spark)}/marlstone/{spark.sparkContext.applicationId}"
    if root not in _ending:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(place)  # only what is there can be marked
        store.deleteOnExit(place)
        _ending.add(root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Drops all that this application has written there; for long sessions, once their results are saved."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/marlstone/{spark.sparkContext.applicationId}")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, so that a lost executor costs no work before them."""
    path = fresh_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, order: list[str | Column], weight: Column, name: str) -> DataFrame:
    """Sum of the weights of all rows up to and with each row, in the order given, which no two rows share.

    Rows are dealt out by range and summed in each part; only the parts' totals
    meet in one place, so the table may be of any size.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"__k{i}" for i in range(len(cols))]
    dealt = df.withColumns({**dict(zip(keys, cols, strict=True)), "__weight": weight}).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "running")
    totals = dealt.groupBy("__part").agg(F.sum("__weight").alias("__sum"))  # a row for each partition
    before = totals.select("__part", (F.sum("__sum").over(W.orderBy("__part")) - F.col("__sum")).alias("__before"))
    inside = F.sum("__weight").over(W.partitionBy("__part").orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow))
    return dealt.withColumn("__inside", inside).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside", "__weight", *keys)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Row numbers from 1 over the whole table."""
    return running_sum(df, order, F.lit(1).cast("long"), name)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """The table marked for broadcast if it has at most ``rows`` rows, else as it is; pass narrow, written tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
