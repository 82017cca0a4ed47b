"""Named tables, lookups and results kept for reuse."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.dml import visible
from quern.plans.policy import Policies
from quern.query import Query


@dataclass
class Catalog:
    """Tables by name; each is also a temporary view for SQL."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    policies: dict[str, Policies] = field(default_factory=dict)
    current: str | None = None
    _kept: dict[int, tuple[DataFrame, float]] = field(default_factory=dict)

    def mount(self, name: str, table: DataFrame | str) -> DataFrame:
        """A DataFrame, or a folder of Parquet."""
        df = self.spark.read.parquet(table) if isinstance(table, str) else table
        self.tables[name] = df
        visible(df).createOrReplaceTempView(name)
        self.current = self.current or name
        return df

    def use(self, name: str) -> None:
        if name not in self.tables:
            raise KeyError(f"no such table: {name}")
        self.current = name

    def unmount(self, name: str) -> None:
        self.tables.pop(name)
        self.spark.catalog.dropTempView(name)
        self.current = next(iter(self.tables), None) if self.current == name else self.current

    def query(self, name: str | None = None, user: dict | None = None, operation: str = "select") -> Query:
        """A query on a table (the current one by default) as the user sees it."""
        name = name or self.current
        rules = self.policies.get(name)
        return Query(self.tables[name], None if rules is None else rules.condition(operation, user or {}))

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def schema(self) -> DataFrame:
        """(table, field, type)."""
        rows = [(t, c, k) for t, df in self.tables.items() for c, k in df.dtypes]
        return self.spark.createDataFrame(rows, "table string, field string, type string")

    def cached(self, df: DataFrame, seconds: float = math.inf) -> DataFrame:
        """The same plan is kept in executor storage once, and made anew when it is older than ``seconds``; ``clear`` lets go."""
        key, now = df.semanticHash(), time.monotonic()
        if key in self._kept and now - self._kept[key][1] >= seconds:
            self._kept.pop(key)[0].unpersist()
        if key not in self._kept:
            self._kept[key] = (df.persist(), now)
        return self._kept[key][0]

    def clear(self) -> None:
        for df, _ in self._kept.values():
            df.unpersist()
        self._kept.clear()


def get(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def get_many(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def get_ordered(df: DataFrame, ids: Sequence, key: str = "id", position: str = "position") -> DataFrame:
    """A row for each id asked for, in that order; missing ones have a position and the key alone."""
    spark = df.sparkSession
    kind = df.schema[key].dataType
    asked = spark.createDataFrame([(list(ids),)], f"ids array<{kind.simpleString()}>").select(F.posexplode("ids").alias(position, key))
    return asked.join(df, key, "left").orderBy(position)


def page(df: DataFrame, offset: int, limit: int, key: str = "id") -> DataFrame:
    """By the key's text; negative numbers are an error."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit can't be negative")
    return df.orderBy(F.col(key).cast("string"), key).offset(offset).limit(limit)


def by_project(df: DataFrame, project: str) -> DataFrame:
    return df.where(F.col("project") == project)


def by_fields(df: DataFrame, **values) -> DataFrame:
    """Equality on one or more fields; files sorted or partitioned by them are pruned."""
    out: Column = F.lit(True)
    for c, v in values.items():
        out = out & (F.col(c) == F.lit(v))
    return df.where(out)


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The fields of a DDL schema, cast; values that don't fit are missing."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key)


def key_lookup(df: DataFrame, path: str, kind: str = "kind", key: str = "id") -> DataFrame:
    """``namespace:id``."""
    namespace, _, value = path.partition(":")
    return df.where((F.lower(kind) == namespace.lower()) & (F.lower(F.col(key).cast("string")) == value.lower()))
