"""Ordinal cumulative-link regression on graded ratings (operator 5).

P(grade > k) = sigmoid(w.x - b_k) with one weight vector for all grades and
ordered thresholds b_0 < b_1 < ...; x are the hashed distinct words of the whole
text, the signs that trail its words, and whether it has words in capitals. From
the model come the expected grade and the probability of the top grade, by which
documents are kept.

Weights are fitted by adaptive gradient steps with an L1 penalty, so that a
feature with no steady bearing on the grade has no weight and a long text's many
common words add no noise. The model is fitted on at most ``fit_rows`` rated
documents of at most ``fit_features`` features together, one row for each id,
chosen by a hash of the id; so what reaches the driver is bounded. Every document
is scored.

Null or empty text has no features and gets the thresholds' own probabilities. A
document with several ratings has the lowest; of rows that repeat a rated id one
is fitted, and all are scored. Ratings of unknown documents and null ratings are
left out; a grade outside 0 to n_grades - 1 is an error. Without ratings of two
grades there is nothing to fit and the figures are null. Other columns are left
out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, in_parts, materialize, texts_of

EDGE = b".,;:!?()[]\"'|"
SIGNS = EDGE + b"#*$%&<>"


def text_features(text: bytes, bits: int) -> np.ndarray:
    """Hashed features of a text."""
    crc, out = zlib.crc32, set()
    for w in set(text.split()):
        core = w.strip(EDGE)
        out.add(crc(core.lower()))
        if trail := w[len(w.rstrip(SIGNS)) :]:
            out.add(crc(b"\0trail" + trail))
        if len(core) > 1 and core.isupper():
            out.add(crc(b"\0capitals"))
    return np.unique(np.fromiter(out, np.int64, len(out)) & ((1 << bits) - 1)).astype(np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _ordered(free: np.ndarray) -> np.ndarray:
    """Thresholds: the first one and positive steps."""
    return np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def link_loss(score: np.ndarray, grades: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of the grades, and its slopes by each row's score and by the free threshold parameters."""
    row, ends = np.arange(len(score)), np.ones((len(score), 1))
    above = np.concatenate([ends, _sigmoid(score[:, None] - _ordered(free)), 0 * ends], axis=1)
    slope, p = above * (1 - above), np.maximum(above[row, grades] - above[row, grades + 1], 1e-9)
    by_cut = np.zeros(above.shape[1])
    np.add.at(by_cut, grades, slope[row, grades] / p)
    np.add.at(by_cut, grades + 1, -slope[row, grades + 1] / p)
    by_cut = by_cut[1:-1]
    by_free = np.concatenate([[by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(free[1:])])
    return float(-np.log(p).sum()), -(slope[row, grades] - slope[row, grades + 1]) / p, by_free


class CumulativeLink:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray, bits: int):
        self.weights, self.cuts, self.bits = weights, cuts, bits

    def tails(self, features: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return _sigmoid(float(self.weights[features].sum()) - self.cuts)

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, *, passes: int = 25, rate: float = 0.1, sparsity: float = 0.09, least_rows: int = 3, seed: int = 5) -> CumulativeLink:
        """The exact cumulative-link likelihood, by adaptive steps; features of fewer than ``least_rows`` rows have no weight."""
        rng, n = np.random.default_rng(seed), len(rows)
        found_in = np.bincount(np.concatenate(rows), minlength=1 << bits)
        rows = [r[found_in[r] >= least_rows] for r in rows]
        w, w_sum = np.zeros(1 << bits), np.full(1 << bits, 1e-2)
        share = np.clip([(grades > k).mean() for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
        start = -np.log(share / (1 - share))
        free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
        free_sum = np.full(len(free), 1e-2)
        for _ in range(passes):
            for part in np.array_split(rng.permutation(n), max(1, n // 32)):
                features = np.concatenate([rows[i] for i in part])
                owner = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
                _, by_score, by_free = link_loss(np.bincount(owner, w[features], len(part)), grades[part], free)
                own, back, uses = np.unique(features, return_inverse=True, return_counts=True)
                by_w = np.bincount(back, by_score[owner], len(own))
                w_sum[own] += by_w**2
                step = rate / np.sqrt(w_sum[own])
                moved = w[own] - step * by_w
                w[own] = np.sign(moved) * np.maximum(np.abs(moved) - step * sparsity * np.sqrt(uses), 0)
                free_sum += by_free**2
                free -= rate * by_free / np.sqrt(free_sum)
        return cls(w, _ordered(free), bits)


def grade_documents(docs: DataFrame, ratings: DataFrame, *, n_grades: int = 3, fit_rows: int = 12_000, fit_features: int = 16_000_000, bits: int = 18, keep_tail: float = 0.5, seed: int = 5) -> DataFrame:
    """docs: doc_id, text; ratings: doc_id, grade from 0 to n_grades - 1. Grade probabilities and verdict for each row of docs."""
    spark = docs.sparkSession
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"), F.max("grade").alias("most"))
    if not rated.filter((F.col("grade") < 0) | (F.col("most") >= n_grades)).isEmpty():
        raise ValueError(f"grades must be from 0 to {n_grades - 1}")
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = materialize(rated.orderBy(order, "doc_id").limit(fit_rows).select("doc_id", "grade"), "rated")
    kind = dict(docs.dtypes)["doc_id"]
    # at most fit_rows rows are broadcast; copies of a row meet in partial aggregates first
    hashed = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(lambda it: _hashed(it, bits), f"doc_id {kind}, grade int, features array<int>")
    one = materialize(hashed.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("features"), "grade", "features")).alias("x")).select("doc_id", "x.grade", "x.features"), "fit")
    sizes = one.select("doc_id", F.size("features").alias("n"))  # fit_rows narrow rows
    upto = sizes.select("doc_id", F.sum("n").over(W.orderBy(order, "doc_id")).alias("upto")).filter(F.col("upto") <= fit_features)
    fit = one.join(F.broadcast(upto.select("doc_id")), "doc_id", "left_semi").toArrow().sort_by("doc_id")
    grades = fit["grade"].to_numpy()
    if not len(grades) or len(set(grades.tolist())) < 2:
        return docs.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(None).cast("double").alias("low_probability"), F.lit(None).cast("boolean").alias("kept"))
    features = [np.asarray(x, np.int32) for x in fit["features"].to_numpy()]
    model = CumulativeLink.fit(features, grades, n_grades, bits, seed=seed)
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts, bits))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CumulativeLink(*sent.value)
        for batch in in_parts(batches):
            tails = np.array([model.tails(text_features(t, model.bits)) for t in texts_of(batch)]).reshape(-1, len(model.cuts))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(1 - tails[:, 0])], names=["doc_id", "expected_grade", "tail_probability", "low_probability"])

    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, expected_grade double, tail_probability double, low_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= keep_tail)


def _hashed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "grade"), pa.array([text_features(t, bits) for t in texts_of(batch)], pa.list_(pa.int32()))], names=["doc_id", "grade", "features"])
