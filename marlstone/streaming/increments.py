"""New files as they arrive: each is parsed once and its evidence added to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import evidence
from ..operators.inventory import with_names
from ..sources.files import _relative, parse


def watch(spark: SparkSession, folder: str, index: str, checkpoint: str, *, files_per_batch: int = 1000, once: bool = False) -> StreamingQuery:
    """Starts the stream. The file source's own log tells which files are new.

    Each micro-batch writes its own partition, replacing it, so a batch that is
    run again after a failure adds nothing twice.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def add(batch: DataFrame, batch_id: int) -> None:
        files = with_names(batch.select(_relative(F.col("path"), folder).alias("path"), F.col("length").alias("size"), "content"))
        units = evidence.corpus(evidence.evidence_units(parse(files).filter("status = 'completed'")))
        units.select("path", "evidence_id", "seq", "page", "text", "content_sha256").write.mode("overwrite").parquet(f"{index}/batch={batch_id}")

    started = found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started.trigger(processingTime="30 seconds")).start()


def indexed(spark: SparkSession, index: str) -> DataFrame:
    """The index: of a file that came more than once, the newest batch."""
    rows = spark.read.parquet(index)
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["path", "batch"], "left_semi")
