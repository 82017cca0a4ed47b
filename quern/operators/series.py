"""XY series for charts: group by a category or a time bin, aggregate, smooth, order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import predicates
from quern.functions.exprs import time_bin
from quern.operators.aggregates import Aggregate
from quern.operators.windows import moving


@dataclass(frozen=True)
class Series:
    """Built step by step; ``to_df`` gives columns x and y, ordered by x."""

    source: DataFrame
    field: str | None = None
    unit: str | None = None
    aggregate: Aggregate | None = None
    filters: tuple[Column, ...] = ()
    window: tuple[str, int] | None = None
    ascending: bool = True

    def x(self, field: str, unit: str | None = None) -> Series:
        return replace(self, field=field, unit=unit)

    def y(self, kind: str, field: str | None = None) -> Series:
        return replace(self, aggregate=Aggregate(kind, field, "y"))

    def where(self, condition: Column | str, **tests) -> Series:
        """A Column, or a field and tests as for ``Query.where``."""
        added = (condition,) if isinstance(condition, Column) else tuple(predicates.BY_NAME[k](condition, v) for k, v in tests.items())
        return replace(self, filters=(*self.filters, *added))

    def moving_average(self, n: int) -> Series:
        return replace(self, window=("avg", n))

    def moving_sum(self, n: int) -> Series:
        return replace(self, window=("sum", n))

    def sorted(self, ascending: bool = True) -> Series:
        return replace(self, ascending=ascending)

    def to_df(self) -> DataFrame:
        if self.field is None or self.aggregate is None:
            raise ValueError("a series needs x and y")
        if self.field not in self.source.columns:
            raise ValueError(f"no such field: {self.field}")
        df = self.source
        for f in self.filters:
            df = df.where(f)
        x = time_bin(self.field, self.unit) if self.unit else F.col(self.field)
        y = self.aggregate.column()
        out = df.where(F.col(self.field).isNotNull()).groupBy(x.alias("x")).agg(y.alias("y"))
        if self.window:
            kind, n = self.window
            out = moving(out, "x", "y", n, kind, "y")
        return out.orderBy(F.col("x").asc_nulls_last() if self.ascending else F.col("x").desc_nulls_last())

    def points(self) -> list[tuple]:
        return [tuple(r) for r in self.to_df().collect()]


def from_json(df: DataFrame, request: dict, where=None) -> DataFrame:
    """The series that a request names: xField, xDateBin, yAggregation, yField, filter, limit."""
    from quern.plans.parse import condition

    s = Series(df).x(request["xField"], request.get("xDateBin")).y(request.get("yAggregation", "count"), request.get("yField"))
    for f in request.get("filter") or []:
        s = s.where(condition(f))
    if where is not None:
        s = s.where(where)
    if request.get("movingAverage"):
        s = s.moving_average(int(request["movingAverage"]))
    if request.get("movingSum"):
        s = s.moving_sum(int(request["movingSum"]))
    out = s.sorted(request.get("ascending", True)).to_df()
    return out.limit(int(request["limit"])) if request.get("limit") else out
