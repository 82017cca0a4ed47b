"""Set operations on records by identity: the ``key`` column, not the whole row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*branches: DataFrame, key: str = "id") -> DataFrame:
    """Each key once, from the first branch that has it; rows without a key go.

    The first row is found by an aggregate, so it is reduced before the
    shuffle; of several rows of one branch the least one stays.
    """
    every = union_all(*[b.withColumn("__branch", F.lit(i)) for i, b in enumerate(branches)])
    columns = [c for c in every.columns if c != "__branch"]
    kept = every.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("__branch", *[c for c in columns if c != key])).alias("__row"))
    return kept.select(*[F.col(key) if c == key else F.col("__row")[c].alias(c) for c in columns])


def union_all(*branches: DataFrame) -> DataFrame:
    """All rows; columns that a branch lacks are missing there."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def intersect(first: DataFrame, *others: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the first whose key is in all others."""
    for o in others:
        first = first.join(o.select(key).distinct(), key, "left_semi")
    return first


def except_(first: DataFrame, *others: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the first whose key is in none of the others; rows without a key go."""
    first = first.where(F.col(key).isNotNull())
    for o in others:
        first = first.join(o.select(key), key, "left_anti")
    return first
