"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """From -1 to 1; 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at unit length, nulls in it as 0; one without length stays as it is."""
    x = F.transform(a, lambda e: F.coalesce(e.cast("double"), F.lit(0.0)))
    return let(F.struct(x.alias("x"), F.greatest(norm(a), F.lit(1e-300)).alias("n")), lambda t: F.transform(t["x"], lambda e: e / t["n"]))


def sign_bits(a: Column, n: int = 16) -> Column:
    """The first n signs as a number, the first one highest."""
    return F.aggregate(F.slice(a, 1, n), F.lit(0).cast("long"), lambda s, x: s * 2 + (x >= 0).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")
