"""The fluent query: immutable, lowered to one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import exprs, geo, predicates, search, vector
from quern.operators import aggregates as A
from quern.operators import joins, setops, subquery, windows
from quern.operators.dml import visible

Step = Callable[[DataFrame], DataFrame]


class InvalidQuery(ValueError):
    pass


@dataclass(frozen=True)
class Query:
    """Steps up to grouping run in the order of the calls; then grouping, HAVING, windows, set operations, sort, offset, limit and projection."""

    source: DataFrame
    policy: Column | None = None
    steps: tuple[Step, ...] = ()
    keys: tuple[str | Column, ...] = ()
    aggregates: tuple[A.Aggregate, ...] = ()
    having_: tuple[Column, ...] = ()
    windows: tuple[windows.WindowFunction, ...] = ()
    combined: tuple[Step, ...] = ()
    order: tuple[Column, ...] = ()
    sorted_by: tuple[str, ...] = ()
    skip: int = 0
    most: int | None = None
    columns: tuple[str | Column, ...] = ()
    hidden: bool = False
    marks: frozenset[str] = frozenset()

    # filters

    def _step(self, f: Step, mark: str | None = None) -> Query:
        return replace(self, steps=(*self.steps, f), marks=self.marks | ({mark} if mark else set()))

    def where(self, field: str | Column | Callable[[DataFrame], Column], **tests) -> Query:
        """A Column, a function of the DataFrame, or a field and tests by name; all are ANDed."""
        if isinstance(field, Column):
            return self._step(lambda df: df.where(field))
        if callable(field):
            return self._step(lambda df: df.where(field(df)))
        if not tests:
            raise InvalidQuery("where needs a test")
        conditions = []
        for name, value in tests.items():
            if name not in predicates.BY_NAME:
                raise InvalidQuery(f"no such test: {name}")
            conditions.append(predicates.BY_NAME[name](field, value))
        return self._step(lambda df: df.where(predicates.all_of(*conditions) if len(conditions) > 1 else conditions[0]))

    def where_row(self, f: Callable[[dict], bool], *fields: str) -> Query:
        """A Python function of a row's named fields; Columns are faster where they can say it."""
        return self._step(lambda df: df.where(predicates.row_test(f, *fields)))

    def where_any(self, *conditions: Column) -> Query:
        return self._step(lambda df: df.where(predicates.any_of(*conditions)))

    def where_range(self, field: str, low=None, high=None) -> Query:
        return self._step(lambda df: df.where(predicates.within(field, low, high)))

    def where_missing(self, field: str) -> Query:
        return self.where(field, missing=True)

    def where_present(self, field: str) -> Query:
        return self.where(field, missing=False)

    def by_id(self, value, key: str = "id") -> Query:
        return self.where(key, equals=value)

    def recent(self, days: int, field: str = "createdAt", *, now: str) -> Query:
        return self._step(lambda df: df.where(predicates.recent(field, days, now)))

    def namespace(self, name: str, field: str = "kind") -> Query:
        """Rows of one kind; kinds are compared without case."""
        return self._step(lambda df: df.where(F.lower(field) == name.lower()))

    # subqueries

    def where_in(self, field: str, sub: Query | DataFrame, column: str | None = None) -> Query:
        return self._step(lambda df: subquery.in_subquery(df, field, _df(sub), column))

    def where_not_in(self, field: str, sub: Query | DataFrame, column: str | None = None, keep_missing: bool = False) -> Query:
        return self._step(lambda df: subquery.not_in_subquery(df, field, _df(sub), column, keep_missing))

    def where_exists(self, sub: Query | DataFrame) -> Query:
        return self._step(lambda df: subquery.exists(df, _df(sub)))

    def where_not_exists(self, sub: Query | DataFrame) -> Query:
        return self._step(lambda df: subquery.not_exists(df, _df(sub)))

    def where_correlated(self, field: str, how: str, sub: Query | DataFrame, outer_key: str, inner_key: str, value: Column) -> Query:
        return self._step(lambda df: subquery.correlated(df, field, how, _df(sub), outer_key, inner_key, value))

    # joins and computed fields

    def join(self, other: Query | DataFrame, on: str | Sequence[str], equals: str | Sequence[str] = "id", kind: str = "inner") -> Query:
        return self._step(lambda df: joins.join(df, _df(other), on, equals, kind), "joined")

    def compute(self, alias: str, expression) -> Query:
        return self._step(lambda df: df.withColumn(alias, exprs.value(expression)))

    def case_when(self, clauses: list[tuple[Column, object]], otherwise=None, alias: str = "case") -> Query:
        return self._step(lambda df: df.withColumn(alias, exprs.case(clauses, otherwise)))

    # search

    def search(self, text: str, fields: list[str] | None = None, case_sensitive: bool = False, min_length: int = 2, index: search.Index | None = None) -> Query:
        """Adds ``score``.  An index is used if it is given and case does not matter; without fields, those of the index or all string columns are searched."""
        return self._step(lambda df: search.search(df, text, fields, case_sensitive, min_length, index), "search")

    def nearest(self, field: str, to: Sequence[float], limit: int | None = None, threshold: float | None = None, tie: Sequence[str] = ()) -> Query:
        return self._step(lambda df: vector.nearest(df, field, to, limit, threshold, tie))

    def within_radius(self, lat: float, lon: float, metres: float, lat_field: str = "latitude", lon_field: str = "longitude") -> Query:
        return self._step(lambda df: df.where(geo.within_radius(lat_field, lon_field, lat, lon, metres)))

    def in_box(self, min_lat: float, max_lat: float, min_lon: float, max_lon: float, lat_field: str = "latitude", lon_field: str = "longitude") -> Query:
        return self._step(lambda df: df.where(geo.in_box(lat_field, lon_field, min_lat, max_lat, min_lon, max_lon)))

    def order_by_distance(self, lat: float, lon: float, lat_field: str = "latitude", lon_field: str = "longitude") -> Query:
        return replace(self, order=(*self.order, geo.haversine(lat_field, lon_field, lat, lon).asc_nulls_last()))

    # grouping and windows

    def group_by(self, *keys: str | Column) -> Query:
        return replace(self, keys=(*self.keys, *keys))

    def _aggregate(self, a: A.Aggregate) -> Query:
        return replace(self, aggregates=(*self.aggregates, a))

    def count(self, alias: str | None = None) -> Query:
        return self._aggregate(A.count(alias))

    def sum(self, field: str, alias: str | None = None) -> Query:
        return self._aggregate(A.sum_(field, alias))

    def avg(self, field: str, alias: str | None = None) -> Query:
        return self._aggregate(A.avg(field, alias))

    def min(self, field: str, alias: str | None = None) -> Query:
        return self._aggregate(A.min_(field, alias))

    def max(self, field: str, alias: str | None = None) -> Query:
        return self._aggregate(A.max_(field, alias))

    def having(self, condition: Column) -> Query:
        """Over the aggregates' names; several are ANDed."""
        return replace(self, having_=(*self.having_, condition))

    def window(self, kind: str, alias: str, order: Sequence[str], partition: Sequence[str] = (), field: str | None = None, offset: int = 1) -> Query:
        return replace(self, windows=(*self.windows, windows.WindowFunction(kind, alias, tuple(order), tuple(partition), field, offset)))

    # set operations

    def union(self, *others: Query | DataFrame, key: str = "id") -> Query:
        return self._combine(lambda df: setops.union(df, *map(_df, others), key=key))

    def union_all(self, *others: Query | DataFrame) -> Query:
        return self._combine(lambda df: setops.union_all(df, *map(_df, others)))

    def intersect(self, *others: Query | DataFrame, key: str = "id") -> Query:
        return self._combine(lambda df: setops.intersect(df, *map(_df, others), key=key))

    def except_(self, *others: Query | DataFrame, key: str = "id") -> Query:
        return self._combine(lambda df: setops.except_(df, *map(_df, others), key=key))

    def _combine(self, f: Step) -> Query:
        """A sort, offset or limit so far belongs to the first branch."""
        if self.order or self.skip or self.most is not None or self.columns:
            first = self.to_df()
            return Query(first, combined=(lambda df: f(df),))
        return replace(self, combined=(*self.combined, f))

    # order and extent

    def order_by(self, *fields: str, descending: bool = False) -> Query:
        """By fields; a leading "-" or ``descending`` reverses; missing values come last either way."""
        new = tuple(windows.order_column(f"-{f}" if descending and not f.startswith("-") else f) for f in fields)
        return replace(self, order=(*self.order, *new), sorted_by=(*self.sorted_by, *[f.removeprefix("-") for f in fields]))

    def offset(self, n: int) -> Query:
        return replace(self, skip=max(0, n))

    def limit(self, n: int) -> Query:
        return replace(self, most=max(0, n))

    def page(self, number: int, size: int = 20) -> Query:
        """Pages count from 1."""
        if number < 1 or size < 1:
            raise InvalidQuery("pages and sizes count from 1")
        return self.offset((number - 1) * size).limit(size)

    def page_from_zero(self, number: int, size: int = 20) -> Query:
        """Pages count from 0."""
        return self.page(number + 1, size)

    def project(self, *columns: str | Column) -> Query:
        return replace(self, columns=(*self.columns, *columns))

    def hint(self, name: str, *arguments) -> Query:
        """An optimiser hint on the rows so far."""
        return self._step(lambda df: df.hint(name, *arguments))

    # lowering

    def to_df(self) -> DataFrame:
        df = self.source if self.hidden else visible(self.source)
        if self.policy is not None:
            df = df.where(self.policy)
        for s in self.steps:
            df = s(df)
        if self.keys or self.aggregates:
            if not self.aggregates:
                raise InvalidQuery("groupBy needs an aggregate")
            df = A.aggregate(df, self.keys, self.aggregates, self.having_)
        elif self.having_:
            raise InvalidQuery("having needs an aggregate")
        df = windows.apply(df, self.windows)
        for s in self.combined:
            df = s(df)
        for f in self.sorted_by:
            if "." not in f and f not in df.columns:
                raise InvalidQuery(f"no field {f} to sort by" + _suggested(f, df.columns))
        if self.order:
            df = df.orderBy(*self.order)
        if self.skip:
            df = df.offset(self.skip)
        if self.most is not None:
            df = df.limit(self.most)
        return df.select(*self.columns) if self.columns else df

    execute = to_df

    def result(self) -> Result:
        kind = "grouped" if self.keys else "aggregation" if self.aggregates else next((k for k in ("search", "joined") if k in self.marks), "records")
        return Result(kind, self.to_df())

    def later(self, action: Callable[[DataFrame], object] = DataFrame.collect) -> Future:
        """The action's outcome as a future; at most IN_FLIGHT run at once, and others wait."""
        df = self.to_df()
        return _POOL.submit(lambda: action(df))

    def first(self):
        return self.limit(1).to_df().first()

    def exists(self) -> bool:
        return not self.limit(1).to_df().isEmpty()

    def rows(self) -> int:
        return self.to_df().count()

    def lazy(self):
        """Rows one by one, soft-deleted ones included, at most one sort key and no offset; one partition at a time is on the driver."""
        if len(self.sorted_by) > 1 or self.skip:
            raise InvalidQuery("a lazy scan takes one sort key and no offset")
        return replace(self, hidden=True).to_df().toLocalIterator()

    def in_batches(self, size: int, *order: str) -> DataFrame:
        """The rows with the number of their batch of ``size``, from 0, in the order given; no task holds all rows."""
        out = windows.numbered(self.to_df(), order, "batch")
        return out.withColumn("batch", F.floor((F.col("batch") - 1) / size))

    def batches(self, size: int):
        """Lists of rows, fetched partition by partition; the driver holds one partition at a time."""
        held = []
        for row in self.to_df().toLocalIterator():
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def explain(self, mode: str = "formatted") -> str:
        from quern.plans.explain import explain

        return explain(self.to_df(), mode)


#: Queries that run at the same time.
IN_FLIGHT = 100
_POOL = ThreadPoolExecutor(IN_FLIGHT, "query")


@dataclass(frozen=True)
class Result:
    """The rows of a query by the kind of query: records, joined, aggregation, grouped or search."""

    kind: str
    df: DataFrame

    def of(self, kind: str) -> DataFrame:
        """The rows, if the query is of that kind."""
        if kind != self.kind:
            raise InvalidQuery(f"the result is {self.kind}, not {kind}")
        return self.df

    def of_or_none(self, kind: str) -> DataFrame | None:
        return self.df if kind == self.kind else None

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()


def edits(a: str, b: str) -> int:
    """Levenshtein distance, without case."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a.lower(), 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b.lower(), 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _suggested(name: str, known: Sequence[str]) -> str:
    near = sorted((edits(name, k), k) for k in known if edits(name, k) <= 2)
    return f"; did you mean {', '.join(k for _, k in near)}?" if near else ""


def _df(x: Query | DataFrame) -> DataFrame:
    return x.to_df() if isinstance(x, Query) else x
