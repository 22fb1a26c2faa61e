"""Exact nearest neighbours among vectors, by tiles that pivots let pass over.

Rows are dealt by the pivot that is nearest to them (a bounded number of rows, by
hash) and written in that order. Questions go to the rows in blocks of a bounded
size; a task streams its rows, tile by tile, and keeps the best of each question so
far. A tile is passed over for all questions that it can't serve: by the angle to
its pivot, its radius and its longest row, no row of it can be as near as the
question's best. What leaves a task is no more than the best of each question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Rows that serve as pivots at most; rows of a tile; questions sent out at once.
PIVOTS, TILE, BLOCK = 256, 2048, 4096
#: Scores closer than this are ties, so that none is lost to the order of adding.
SLACK = 2e-6
PARTNERS = "a long, b long, score double"


def unit_rows(rows: list) -> np.ndarray:
    """Rows of unit length; a row without length stays nought."""
    x = _matrix(rows)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _matrix(rows: list) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in rows]).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def dealt(vectors: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """vectors: id, v. The rows with the pivot that is nearest, in the pivots' order, and the pivots' directions."""
    few = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").toArrow()  # ``pivots`` rows
    centres = unit_rows(few["v"].to_pylist())
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (unit_rows(batch.column(1).to_pylist()) @ sent.value.T).argmax(axis=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32())], names=["id", "v", "cell"])

    placed = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(place, "id long, v array<double>, cell int")
    return materialize(placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "cells"), centres


class Best:
    """The best k rows of each question so far, and all that tie with the last of them."""

    def __init__(self, width: int, k: int, floor: float):
        self.width, self.k, self.floor = width, k, floor
        self.question, self.row, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(width, floor)

    def add(self, question: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        q, r, s = np.concatenate([self.question, question]), np.concatenate([self.row, row]), np.concatenate([self.score, score])
        order = np.lexsort((-s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.searchsorted(q, np.arange(self.width))
        count = np.bincount(q, minlength=self.width)
        full = np.flatnonzero(count >= self.k)
        self.least[full] = np.maximum(self.least[full], s[first[full] + self.k - 1])
        keep = s >= self.least[q] - SLACK
        self.question, self.row, self.score = q[keep], r[keep], s[keep]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for i in range(a, b, TILE):
                j = min(b, i + TILE)
                yield int(cells[i]), ids[i:j], _matrix(batch.column(1).slice(i, j - i).to_pylist())


def _lengths_and_angles(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.linalg.norm(x, axis=1)
    unit = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
    return length, np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


def best_partners(rows: DataFrame, centres: np.ndarray, asked: DataFrame, *, k: int = 1, floor: float = -np.inf, block: int = BLOCK) -> DataFrame:
    """a, b, score: for each question (id, v) the rows with the k largest inner products that reach the floor, ties and near ties with the last included, itself left out.

    rows, centres: what ``dealt`` gives. A task's best are not yet all rows' best.
    """
    spark, found = rows.sparkSession, None
    parts = max(1, -(-asked.count() // block))
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part) if parts > 1 else asked
        table = own.select("id", "v").toArrow()  # about ``block`` rows
        sent = spark.sparkContext.broadcast((np.array(table["id"].to_pylist(), np.int64), _matrix(table["v"].to_pylist()), centres))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, x, centres = sent.value
            best = Best(len(names), k, floor)
            length, angle = _lengths_and_angles(x, centres) if len(names) else (None, None)
            for cell, ids, tile in _tiles(batches) if len(names) else ():
                long, spread = _lengths_and_angles(tile, centres[cell : cell + 1])
                apart = np.maximum(angle[:, cell] - spread.max(), 0.0)
                most = length * long.max() * np.cos(apart)
                at = np.flatnonzero(np.maximum(most, 0.0) >= best.least - SLACK)
                for i in range(0, len(at), 512):
                    few = at[i : i + 512]
                    score = x[few] @ tile.T
                    near = (score >= best.least[few, None] - SLACK) & (score >= floor) & (names[few, None] != ids[None, :])
                    q, r = np.nonzero(near)
                    best.add(few[q], ids[r], score[q, r])
            yield pa.RecordBatch.from_arrays([pa.array(names[best.question]), pa.array(best.row), pa.array(best.score)], names=["a", "b", "score"])

        one = rows.mapInArrow(run, PARTNERS)
        found = one if found is None else found.unionByName(one)
    return found


def nearest(rows: DataFrame, centres: np.ndarray, asked: DataFrame, *, floor: float = -np.inf) -> DataFrame:
    """a, b, score (12 digits): the best row of each question, the smallest id among equals; questions without one are left out."""
    found = best_partners(rows, centres, asked, floor=floor).withColumn("score", F.round("score", 12))
    return found.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("less"), "b")).alias("x")).select("a", F.col("x.b").alias("b"), (-F.col("x.less")).alias("score"))
