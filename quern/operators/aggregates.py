"""Aggregates.  SUM and AVG are doubles and 0 over nothing; MIN and MAX ignore missing values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    kind: str
    field: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (self.kind if self.field is None else f"{self.kind}_{self.field}")

    def column(self) -> Column:
        c = None if self.field is None else F.col(self.field)
        if self.kind == "count":
            return F.count(F.lit(1))
        if self.kind == "sum":
            return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))
        if self.kind == "avg":
            return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
        if self.kind == "min":
            return F.min(c)
        if self.kind == "max":
            return F.max(c)
        raise ValueError(f"no such aggregate: {self.kind}")


def count(alias: str | None = None) -> Aggregate:
    """Rows, not values."""
    return Aggregate("count", None, alias)


def sum_(field: str, alias: str | None = None) -> Aggregate:
    return Aggregate("sum", field, alias)


def avg(field: str, alias: str | None = None) -> Aggregate:
    return Aggregate("avg", field, alias)


def min_(field: str, alias: str | None = None) -> Aggregate:
    return Aggregate("min", field, alias)


def max_(field: str, alias: str | None = None) -> Aggregate:
    return Aggregate("max", field, alias)


def aggregate(df: DataFrame, keys: Sequence[str | Column], aggregates: Sequence[Aggregate], having: Sequence[Column] = ()) -> DataFrame:
    """One row a key (one in all without keys); partial sums are made before the shuffle."""
    if not aggregates:
        raise ValueError("groupBy needs an aggregate")
    out = df.groupBy(*keys).agg(*[a.column().alias(a.name) for a in aggregates])
    for h in having:
        out = out.where(h)
    return out


def distinct(df: DataFrame, field: str) -> DataFrame:
    return df.select(field).where(F.col(field).isNotNull()).distinct()


def grouped(df: DataFrame, field: str, columns: Sequence[str], key: str = "key", rows: str = "rows") -> DataFrame:
    """A key's rows as an array, in the order of ``columns``; for keys whose groups are known to be small."""
    return df.groupBy(F.col(field).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(rows))


def workspace_summary(df: DataFrame, group: str, path: str, size: str, changed: str, suffix: str) -> DataFrame:
    """Files, files with the suffix, bytes, and the last change of each group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col(path).endswith(suffix)).alias("source_files"), F.coalesce(F.sum(F.col(size).cast("double")), F.lit(0.0)).alias("total_size"), F.max(changed).alias("last_change"))
