"""Subqueries as semi, anti and grouped joins; none runs once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Column, Column], Column]] = {"greater": lambda a, b: a > b, "less": lambda a, b: a < b, "equal": lambda a, b: a == b}


def _values(df: DataFrame, field: str, sub: DataFrame, column: str | None) -> DataFrame:
    """The subquery's values as ``__in``: those of one column, or of all columns that can be read as the field's type."""
    if column is not None:
        return sub.select(F.col(column).alias("__in"))
    kind = df.schema[field].dataType
    return sub.select(F.explode(F.array(*[F.col(c).try_cast(kind) for c in sub.columns])).alias("__in"))


def in_subquery(df: DataFrame, field: str, sub: DataFrame, column: str | None = None) -> DataFrame:
    """IN; without ``column``, any column of the subquery may hold the value."""
    return df.join(_values(df, field, sub, column), F.col(field) == F.col("__in"), "left_semi")


def not_in_subquery(df: DataFrame, field: str, sub: DataFrame, column: str | None = None, keep_missing: bool = False) -> DataFrame:
    """NOT IN; the subquery's missing values are ignored, and rows with a missing value go unless ``keep_missing``."""
    out = df.join(_values(df, field, sub, column), F.col(field) == F.col("__in"), "left_anti")
    return out if keep_missing else out.where(F.col(field).isNotNull())


def exists(df: DataFrame, sub: DataFrame) -> DataFrame:
    """All rows if the subquery has one, else none.  One row of the subquery is looked at."""
    return df.join(F.broadcast(sub.limit(1).select(F.lit(1).alias("__one"))), F.lit(True), "left_semi")


def not_exists(df: DataFrame, sub: DataFrame) -> DataFrame:
    return df.join(F.broadcast(sub.limit(1).select(F.lit(1).alias("__one"))), F.lit(True), "left_anti")


def correlated(df: DataFrame, field: str, how: str, sub: DataFrame, outer_key: str, inner_key: str, value: Column) -> DataFrame:
    """Rows whose ``field`` is greater than, less than or equal to ``value``, an aggregate over the subquery's rows with the same key.

    The aggregate is made once a key and joined; keys without rows match nothing.
    """
    each = sub.groupBy(F.col(inner_key).alias("__key")).agg(value.alias("__value"))
    return df.join(each, F.col(outer_key) == F.col("__key")).where(COMPARE[how](F.col(field), F.col("__value"))).drop("__key", "__value")


def with_views(ctes: dict[str, DataFrame], sql: str) -> DataFrame:
    """A query over named results; each name is bound in this query only."""
    spark = next(iter(ctes.values())).sparkSession
    return spark.sql(sql, **ctes)
