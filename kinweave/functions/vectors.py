"""Vector expressions over ARRAY columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x,
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(EPS))


def mean_of_two(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def abs_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def mean_vector(vectors: Column, size: int) -> Column:
    """Element-wise mean of an array of vectors; zeros when there is none."""
    total = F.aggregate(
        vectors, zeros(size),
        lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")),
    )
    return F.transform(total, lambda x: x / F.greatest(F.size(vectors), F.lit(1)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
