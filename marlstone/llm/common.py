"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_folder as fresh_path
from ..storage import materialize

__all__ = ["ascii_lower", "column", "fresh_path", "in_parts", "materialize", "only", "released", "table", "texts_of", "worker_cache"]

#: The ASCII white space that separates words, and the letters that are lower-cased.
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what a task makes of one stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_caches: list[dict] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def worker_cache(cache: dict | None = None) -> dict:
    """A dictionary for what an operator keeps in a worker between tasks."""
    _caches.append({} if cache is None else cache)
    return _caches[-1]


def only(*own: dict) -> None:
    """Workers outlive an operator: what others have kept in this one is let go."""
    for cache in _caches:
        if not any(cache is x for x in own):
            cache.clear()


def give_back() -> None:
    """Freed memory, which Arrow and the C library would keep for later, goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, at whose end the worker gives back what it has freed: an idle worker's memory stands beside the JVM's."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
