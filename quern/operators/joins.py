"""Equality joins of records; rows merge with the left side's values first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str], equals: str | Sequence[str] = "id", kind: str = "inner") -> DataFrame:
    """Joins ``left.on`` with ``right.equals`` (many to many) into merged rows.

    A column of both sides has the left value, or the right one where the
    left is missing.  Missing keys match nothing.  Which side is broadcast or
    sorted is left to the optimiser, which knows sizes at run time.
    """
    a, b = left.alias("l"), right.alias("r")
    condition = _condition(on, equals)
    if kind in ("semi", "anti"):
        return a.join(b, condition, KINDS[kind]).select(*[f"l.{c}" for c in map(_quoted, left.columns)])
    return a.join(b, condition, KINDS[kind]).select(*merged(left.columns, right.columns))


def pairs(left: DataFrame, right: DataFrame, on: str | Sequence[str], equals: str | Sequence[str] = "id", kind: str = "inner") -> DataFrame:
    """The joined sides as two structs, ``left`` and ``right``; a side without a match is null."""
    a = left.select(F.struct(*left.columns).alias("left"))
    b = right.select(F.struct(*right.columns).alias("right"))
    on, equals = _names(on), _names(equals)
    condition = F.lit(True)
    for x, y in zip(on, equals, strict=True):
        condition = condition & (F.col("left")[x] == F.col("right")[y])
    return a.join(b, condition, KINDS[kind])


def complete(joined: DataFrame) -> DataFrame:
    """Pairs with both sides."""
    return joined.where(F.col("left").isNotNull() & F.col("right").isNotNull())


def incomplete(joined: DataFrame) -> DataFrame:
    return joined.where(F.col("left").isNull() | F.col("right").isNull())


def statistics(joined: DataFrame) -> DataFrame:
    """One row: all pairs, complete ones, and those with a side missing."""
    both, left_only, right_only = (F.col("left").isNotNull() & F.col("right").isNotNull()), F.col("right").isNull(), F.col("left").isNull()
    return joined.agg(F.count(F.lit(1)).alias("total"), F.count_if(both).alias("complete"), F.count_if(left_only).alias("left_only"), F.count_if(right_only).alias("right_only"))


def merged(left: Sequence[str], right: Sequence[str]) -> list[Column]:
    out = []
    for c in left:
        out.append(F.coalesce(F.col(f"l.{_quoted(c)}"), F.col(f"r.{_quoted(c)}")).alias(c) if c in right else F.col(f"l.{_quoted(c)}"))
    return out + [F.col(f"r.{_quoted(c)}") for c in right if c not in left]


def _condition(on, equals) -> Column:
    condition = None
    for x, y in zip(_names(on), _names(equals), strict=True):
        one = F.col(f"l.{_quoted(x)}") == F.col(f"r.{_quoted(y)}")
        condition = one if condition is None else condition & one
    return condition


def _names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"
