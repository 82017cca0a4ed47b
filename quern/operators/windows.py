"""Window functions over ROWS UNBOUNDED PRECEDING TO CURRENT ROW.

``order`` lists fields; a leading "-" means descending; missing values come
last in both directions.  Row numbers without a partition are counted by ranges
(``numbered``).  Other functions without a partition put all rows in one task:
use them on results that are small by construction.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import checkpointed


def order_column(field: str) -> Column:
    return F.col(field[1:]).desc_nulls_last() if field.startswith("-") else F.col(field).asc_nulls_last()


def spec(partition: Sequence[str] | None, order: Sequence[str]):
    if not order:
        raise ValueError("a window needs an order")
    w = W.partitionBy(*(partition or []))
    return w.orderBy(*map(order_column, order))


@dataclass(frozen=True)
class WindowFunction:
    kind: str
    alias: str
    order: tuple[str, ...]
    partition: tuple[str, ...] = ()
    field: str | None = None
    offset: int = 1

    def column(self) -> Column:
        w = spec(self.partition, self.order)
        rows = w.rowsBetween(W.unboundedPreceding, W.currentRow)
        c = None if self.field is None else F.col(self.field)
        match self.kind:
            case "row_number":
                return F.row_number().over(w).cast("long")
            case "rank":
                return F.rank().over(w).cast("long")
            case "dense_rank":
                return F.dense_rank().over(w).cast("long")
            case "lag":
                return F.lag(c, self.offset).over(w)
            case "lead":
                return F.lead(c, self.offset).over(w)
            case "sum":
                return F.coalesce(F.sum(c.cast("double")).over(rows), F.lit(0.0))
            case "avg":
                return F.coalesce(F.avg(c.cast("double")).over(rows), F.lit(0.0))
            case "count":
                return F.count(F.lit(1)).over(rows)
            case "min":
                return F.min(c).over(rows)
            case "max":
                return F.max(c).over(rows)
        raise ValueError(f"no such window function: {self.kind}")


def numbered(df: DataFrame, order: Sequence[str | Column], alias: str = "row") -> DataFrame:
    """Row numbers from 1 over all rows, without a task that holds them all.

    Rows are dealt by ranges of the order, counted by range, numbered within
    each, and the counts of the ranges before are added: one number a range
    is all that the driver's side sees.
    """
    order = [order_column(f) if isinstance(f, str) else f for f in order]
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(alias, own).join(F.broadcast(before), "__range").withColumn(alias, F.col(alias) + F.col("__before")).drop("__range", "__before")


def apply(df: DataFrame, functions: Sequence[WindowFunction]) -> DataFrame:
    """All functions in one projection; those with equal windows share a sort."""
    whole = [f for f in functions if f.kind == "row_number" and not f.partition]
    rest = {f.alias: f.column() for f in functions if f not in whole}
    df = df.withColumns(rest) if rest else df
    for f in whole:
        df = numbered(df, f.order, f.alias)
    return df.select(*[c for c in df.columns if c not in {f.alias for f in functions}], *[f.alias for f in functions]) if whole else df


def moving(df: DataFrame, x: str, y: str, n: int, kind: str, alias: str) -> DataFrame:
    """Mean or sum over the row and the n - 1 before it by ascending x; shorter at the beginning.  For short series, such as bins."""
    if n < 1:
        raise ValueError("a moving window has one row at least")
    w = W.orderBy(F.col(x).asc_nulls_last()).rowsBetween(-(n - 1), W.currentRow)
    return df.withColumn(alias, (F.avg if kind == "avg" else F.sum)(F.col(y).cast("double")).over(w))
