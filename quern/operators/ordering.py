"""Manual order by a fractional rank.

A row between two others gets the mean of their ranks, before the first one
less, after the last one more.  Moves touch one row; they look up the ranks
around the place with aggregates, so no table is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.windows import numbered

DEFAULT = 1000.0
RANK = "orderingIndex"


def between(low: float | None, high: float | None) -> float:
    if low is None and high is None:
        return DEFAULT
    if high is None:
        return low + 1.0
    if low is None:
        return high - 1.0
    return low + 0.1 if low == high else (low + high) / 2.0


def _rank_of(df: DataFrame, key: str, at, rank: str) -> float:
    row = df.where(F.col(key) == F.lit(at)).agg(F.min(rank)).first()
    if row[0] is None:
        raise KeyError(f"no rank for {key} {at}")
    return float(row[0])


def _set(df: DataFrame, key: str, at, to: float, rank: str) -> DataFrame:
    return df.withColumn(rank, F.when(F.col(key) == F.lit(at), F.lit(to)).otherwise(F.col(rank).cast("double")))


def enable(df: DataFrame, order: list[str], rank: str = RANK, partition: list[str] | None = None) -> DataFrame:
    """Ranks 1000, 1001, ... in the given order within each partition."""
    if not partition:
        return numbered(df, [F.col(c) for c in order], rank).withColumn(rank, F.col(rank).cast("double") + (DEFAULT - 1))
    w = W.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("double") + (DEFAULT - 1))


def move_before(df: DataFrame, key: str, moved, target, rank: str = RANK, within: Column | None = None) -> DataFrame:
    return _move(df, key, moved, target, rank, within, before=True)


def move_after(df: DataFrame, key: str, moved, target, rank: str = RANK, within: Column | None = None) -> DataFrame:
    return _move(df, key, moved, target, rank, within, before=False)


def _move(df: DataFrame, key: str, moved, target, rank: str, within: Column | None, before: bool) -> DataFrame:
    others = df.where(F.col(key) != F.lit(moved))
    others = others if within is None else others.where(within)
    at = _rank_of(others, key, target, rank)
    if before:
        low = others.where(F.col(rank) < at).agg(F.max(rank)).first()[0]
        to = between(None if low is None else float(low), at)
    else:
        high = others.where(F.col(rank) > at).agg(F.min(rank)).first()[0]
        to = between(at, None if high is None else float(high))
    return _set(df, key, moved, to, rank)


def move_to(df: DataFrame, key: str, moved, index: int, rank: str = RANK, within: Column | None = None) -> DataFrame:
    """To the index-th place (from 0) among the other rows; past the end is the end."""
    others = df.where(F.col(key) != F.lit(moved))
    others = others if within is None else others.where(within)
    around = [float(r[0]) for r in others.where(F.col(rank).isNotNull()).orderBy(rank, key).offset(max(0, index - 1)).limit(2).select(rank).collect()]
    if index <= 0:
        to = between(None, around[0] if around else None)
    elif len(around) == 2:
        to = between(*around)
    else:
        last = others.agg(F.max(rank)).first()[0]
        to = between(None if last is None else float(last), None)
    return _set(df, key, moved, to, rank)


def move_up(df: DataFrame, key: str, moved, rank: str = RANK) -> DataFrame:
    """Past the row before; the first row stays."""
    at = _rank_of(df, key, moved, rank)
    near = [float(r[0]) for r in df.where(F.col(rank) < at).orderBy(F.col(rank).desc()).limit(2).select(rank).collect()]
    return df if not near else _set(df, key, moved, between(near[1] if len(near) > 1 else None, near[0]), rank)


def move_down(df: DataFrame, key: str, moved, rank: str = RANK) -> DataFrame:
    at = _rank_of(df, key, moved, rank)
    near = [float(r[0]) for r in df.where(F.col(rank) > at).orderBy(rank).limit(2).select(rank).collect()]
    return df if not near else _set(df, key, moved, between(near[0], near[1] if len(near) > 1 else None), rank)


def reorder(df: DataFrame, ranks: DataFrame, key: str, rank: str = RANK) -> DataFrame:
    """New ranks for many rows from (key, rank); other rows keep theirs."""
    new = ranks.select(key, F.col(rank).cast("double").alias("__rank"))
    return df.join(new, key, "left").withColumn(rank, F.coalesce("__rank", F.col(rank).cast("double"))).drop("__rank").select(*df.columns)


def neighbours(df: DataFrame, rank: str = RANK, partition: list[str] | None = None) -> DataFrame:
    """The ranks before and after each row within its partition."""
    w = W.partitionBy(*(partition or [])).orderBy(F.col(rank).asc_nulls_last())
    return df.withColumn("before", F.lag(rank).over(w)).withColumn("after", F.lead(rank).over(w))


def in_order(df: DataFrame, rank: str = RANK, tie: tuple[str, ...] = ()) -> DataFrame:
    return df.orderBy(F.col(rank).asc_nulls_last(), *tie)
