"""Changes as transformations: each takes a table and returns the changed one.

Write the result to a new folder and swap; files that a plan reads are never
overwritten in place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.exprs import value
from quern.operators.setops import union_all


def insert(df: DataFrame, new: DataFrame, now: str | None = None, project: str | None = None) -> DataFrame:
    """Adds rows; a text ``id`` that is missing becomes a UUID, ``createdAt`` and ``project`` are filled in where they are asked for."""
    if dict(df.dtypes).get("id") == "string" and "id" not in new.columns:
        new = new.withColumn("id", F.uuid())
    if now is not None:
        stamp = F.lit(now).cast("timestamp_ntz")
        new = new.withColumn("createdAt", F.coalesce("createdAt", stamp) if "createdAt" in new.columns else stamp)
    if project is not None:
        new = new.withColumn("project", F.lit(project))
    return union_all(df, new)


def update_many(df: DataFrame, where: Column, values: Mapping[str, object], now: str | None = None) -> DataFrame:
    """Sets fields on the rows for which the condition is true, and ``updatedAt`` if a time is given."""
    hit = F.coalesce(where, F.lit(False))
    values = {c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()}
    if now is not None:
        values["updatedAt"] = F.lit(now).cast("timestamp_ntz")
    # the condition is taken before any field changes
    out = df.withColumn("__hit", hit)
    types = dict(df.dtypes)
    changed = {c: F.when(F.col("__hit"), v).otherwise(F.col(c) if c in types else F.lit(None)) for c, v in values.items()}
    return out.withColumns({c: x.cast(types[c]) if c in types else x for c, x in changed.items()}).drop("__hit")


def update_ids(df: DataFrame, ids: DataFrame, values: Mapping[str, object], key: str = "id", now: str | None = None) -> DataFrame:
    marked = df.join(ids.select(key).distinct().withColumn("__given", F.lit(True)), key, "left")
    return update_many(marked, F.col("__given"), values, now).drop("__given").select(*df.columns, *[c for c in [*values, *(["updatedAt"] if now else [])] if c not in df.columns])


def update_fields(df: DataFrame, key_value, values: Mapping[str, object], key: str = "id") -> DataFrame:
    return update_many(df, F.col(key) == F.lit(key_value), values)


def upsert(df: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows take the place of those with the same key; of new rows with one key the greatest counts."""
    last = new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("__row")).select(key, "__row.*") if len(new.columns) > 1 else new.distinct()
    return union_all(df.join(last.select(key), key, "left_anti"), last)


def upsert_report(df: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, inserted) of an upsert."""
    known = df.select(key).distinct().withColumn("__known", F.lit(True))
    return new.select(key).distinct().join(known, key, "left").select(key, F.col("__known").isNull().alias("inserted"))


def delete_many(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def soft_delete(df: DataFrame, where: Column, flag: str = "isDeleted") -> DataFrame:
    return update_many(df if flag in df.columns else df.withColumn(flag, F.lit(False)), where, {flag: True})


def visible(df: DataFrame, flag: str = "isDeleted") -> DataFrame:
    """Without soft-deleted rows; a table without the flag as it is."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False))) if flag in df.columns else df


purge = visible


def bulk(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Changes that take effect together: one plan, one write."""
    for s in steps:
        df = s(df)
    return df


def computed(df: DataFrame, fields: Mapping[str, object]) -> DataFrame:
    """Fields in order; a later one may use an earlier one or take its place."""
    for name, expression in fields.items():
        df = df.withColumn(name, value(expression))
    return df
