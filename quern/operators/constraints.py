"""Constraints as queries for the rows that break them; a valid table gives none."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.setops import union_all


@dataclass(frozen=True)
class Field:
    name: str
    kind: str | None = None
    required: bool = False
    valid: Callable[[Column], Column] | None = None
    default: object = None


@dataclass(frozen=True)
class Schema:
    """Fields by name; a strict schema allows no others but ``id`` and ``createdAt``."""

    fields: tuple[Field, ...]
    strict: bool = False
    always: tuple[str, ...] = field(default=("id", "createdAt"))

    def violations(self, df: DataFrame, key: str) -> DataFrame:
        """(key, field, problem): a row for each field of a record that is missing, of another type, or not valid.

        The types of columns are checked once, those of values by trying to read them.
        """
        tests: list[tuple[str, str, Column]] = []
        for f in self.fields:
            if f.name not in df.columns:
                if f.required:
                    tests.append((f.name, "missing", F.lit(True)))
                continue
            c = F.col(f.name)
            if f.required:
                tests.append((f.name, "missing", c.isNull()))
            if f.kind and dict(df.dtypes)[f.name] != f.kind:
                tests.append((f.name, "type", c.isNotNull() & c.try_cast(f.kind).isNull()))
            if f.valid is not None:
                tests.append((f.name, "invalid", c.isNotNull() & ~F.coalesce(f.valid(c), F.lit(False))))
        if self.strict:
            known = {f.name for f in self.fields} | set(self.always)
            tests += [(c, "unknown", F.col(c).isNotNull()) for c in df.columns if c not in known]
        found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(n).alias("field"), F.lit(p).alias("problem"))) for n, p, t in tests])) if tests else F.array().cast("array<struct<field:string,problem:string>>")
        return df.select(key, F.explode(found).alias("v")).select(key, "v.field", "v.problem")

    def with_defaults(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f.name: F.coalesce(F.col(f.name), F.lit(f.default)) if f.name in df.columns else F.lit(f.default) for f in self.fields if f.default is not None})


def check(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false; a missing outcome passes, as in SQL."""
    return df.where(~F.coalesce(condition, F.lit(True)))


def unique(df: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Values that occur more than once; rows with a missing part are exempt."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)


def orphans(df: DataFrame, field_: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose reference leads nowhere; a missing reference is fine."""
    return df.where(F.col(field_).isNotNull()).join(parents.select(F.col(parent_key).alias("__parent")), F.col(field_) == F.col("__parent"), "left_anti")


def on_delete(children: DataFrame, field_: str, deleted: DataFrame, parent_key: str = "id", action: str = "restrict") -> DataFrame:
    """What becomes of the children of deleted parents: cascade drops them, set_null clears the reference, restrict returns the rows that forbid it."""
    gone = deleted.select(F.col(parent_key).alias("__gone")).distinct()
    match = F.col(field_) == F.col("__gone")
    if action == "cascade":
        return children.join(gone, match, "left_anti")
    if action == "set_null":
        marked = children.join(gone, match, "left")
        return marked.withColumn(field_, F.when(F.col("__gone").isNull(), F.col(field_))).drop("__gone").select(*children.columns)
    if action == "restrict":
        return children.join(gone, match, "left_semi")
    raise ValueError(f"no such action: {action}")


def require(df: DataFrame, *fields: str) -> DataFrame:
    """Rows that lack one of the fields."""
    out = F.lit(False)
    for f in fields:
        out = out | F.col(f).isNull()
    return df.where(out)


@dataclass(frozen=True)
class Triggers:
    """Row rewrites before a write and side outputs after it, by event (insert, update, delete)."""

    before: dict[str, tuple[Callable[[DataFrame], DataFrame], ...]] = field(default_factory=dict)
    after: dict[str, tuple[Callable[[DataFrame], None], ...]] = field(default_factory=dict)

    def write(self, event: str, rows: DataFrame, sink: Callable[[DataFrame], None]) -> None:
        """Rewrites the rows, writes them, then runs what follows; an error ends the write."""
        for f in self.before.get(event, ()):
            rows = f(rows)
        sink(rows)
        for f in self.after.get(event, ()):
            f(rows)


@dataclass(frozen=True)
class Migration:
    version: int
    up: Callable[[DataFrame], DataFrame]
    down: Callable[[DataFrame], DataFrame] | None = None


def migrate(df: DataFrame, migrations: Sequence[Migration], start: int, to: int) -> DataFrame:
    """Runs the steps between two versions in order, backwards where ``to`` is lower."""
    steps = sorted(migrations, key=lambda m: m.version)
    if to >= start:
        for m in steps:
            if start < m.version <= to:
                df = m.up(df)
        return df
    for m in reversed(steps):
        if to < m.version <= start:
            if m.down is None:
                raise ValueError(f"version {m.version} can't be undone")
            df = m.down(df)
    return df


def all_violations(*named: tuple[str, DataFrame], key: str) -> DataFrame:
    """(constraint, key) over several checks."""
    return union_all(*[df.select(F.lit(name).alias("constraint"), F.col(key).cast("string").alias("key")) for name, df in named])
