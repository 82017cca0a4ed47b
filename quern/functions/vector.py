"""Vectors: cosine similarity and nearest neighbours of a given vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.predicates import column


def vector(c, kind: str | None = None) -> Column:
    """An array of doubles from a numeric array, or from packed 32-bit floats (``kind`` "binary")."""
    if kind != "binary":
        return column(c).cast("array<double>")
    raise ValueError("packed floats are read with sources.io.unpack_floats")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(c, other: Sequence[float] | Column) -> Column:
    """In doubles; 0 where the lengths differ, a vector is empty or a norm is zero."""
    a = column(c).cast("array<double>")
    b = other if isinstance(other, Column) else F.lit([float(x) for x in other]).cast("array<double>") if len(other) else F.array().cast("array<double>")
    size = norm(a) * norm(b)
    return F.when(a.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).when(size == 0, 0.0).otherwise(F.try_divide(dot(a, b), size))


def nearest(df: DataFrame, c, query: Sequence[float] | Column, limit: int | None = None, threshold: float | None = None, tie: Sequence[str] = (), similarity: str = "similarity") -> DataFrame:
    """Rows by falling similarity; top-k keeps k rows a task, so nothing is sorted as a whole."""
    out = df.withColumn(similarity, cosine(c, query))
    if threshold is not None:
        out = out.where(F.col(similarity) >= threshold)
    if limit is not None:
        out = out.orderBy(F.col(similarity).desc(), *tie).limit(limit)
    return out
