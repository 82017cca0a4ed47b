"""Predicates as Columns, with one policy for missing values.

Positive predicates are false for a missing value; their negations (not
equal, NOT LIKE, NOT regex) are true for it.  Every result is plain true or
false for use under OR and NOT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def equals(c, value) -> Column:
    return column(c).isNull() if value is None else column(c) == F.lit(value)


def not_equals(c, value) -> Column:
    return ~column(c).eqNullSafe(F.lit(value))


def greater(c, value) -> Column:
    return column(c) > F.lit(value)


def less(c, value) -> Column:
    return column(c) < F.lit(value)


def at_least(c, value) -> Column:
    return column(c) >= F.lit(value)


def at_most(c, value) -> Column:
    return column(c) <= F.lit(value)


def contains(c, text: str) -> Column:
    return column(c).contains(text)


def among(c, values: Iterable) -> Column:
    values = list(values)
    return column(c).isin(*values) if values else F.lit(False)


def missing(c) -> Column:
    return column(c).isNull()


def present(c) -> Column:
    return column(c).isNotNull()


def within(c, low=None, high=None) -> Column:
    """Inclusive; an end that is None is open, and with both open any present value fits."""
    c = column(c)
    ends = [e for e in (None if low is None else c >= F.lit(low), None if high is None else c <= F.lit(high)) if e is not None]
    out = ends[0] if ends else c.isNotNull()
    for e in ends[1:]:
        out = out & e
    return out


def like(c, pattern: str) -> Column:
    return column(c).like(pattern)


def ilike(c, pattern: str) -> Column:
    return column(c).ilike(pattern)


def not_like(c, pattern: str) -> Column:
    return column(c).isNull() | ~column(c).like(pattern)


def not_ilike(c, pattern: str) -> Column:
    return column(c).isNull() | ~column(c).ilike(pattern)


def matches(c, pattern: str, ignore_case: bool = False) -> Column:
    """The pattern is found anywhere in the value."""
    return column(c).rlike(f"(?i){pattern}" if ignore_case else pattern)


def not_matches(c, pattern: str, ignore_case: bool = False) -> Column:
    return column(c).isNull() | ~matches(c, pattern, ignore_case)


def binary_longer(c, n: int) -> Column:
    """Binary values are ordered by length."""
    return F.octet_length(column(c)) > n


def recent(c, days: int, now: str) -> Column:
    """Later than ``days`` days before ``now`` (a timestamp in ISO form, so that a query is repeatable)."""
    return column(c) > F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def row_test(f: Callable[[dict], bool], *fields: str) -> Column:
    """A Python function of a row's named fields as a condition, for what Columns cannot say: Arrow batches, but every value passes through Python.

    The outcome of a function that gives None is false.
    """
    import pandas as pd

    def test(*columns: pd.Series) -> pd.Series:
        rows = zip(*[[None if x is pd.NA or x is pd.NaT or x != x else x for x in c.astype(object)] for c in columns], strict=True)
        return pd.Series([bool(f(dict(zip(fields, r, strict=True)))) for r in rows], dtype=bool)

    test.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return F.pandas_udf(test, "boolean")(*[F.col(c) for c in fields])


#: What ``Query.where(field, <name>=value)`` accepts.
BY_NAME: dict[str, Callable] = {
    "equals": equals, "not_equals": not_equals, "greater_than": greater, "less_than": less, "at_least": at_least, "at_most": at_most, "contains": contains, "among": among,
    "like": like, "ilike": ilike, "not_like": not_like, "not_ilike": not_ilike, "matches": matches, "not_matches": not_matches,
    "matches_any_case": lambda c, p: matches(c, p, True), "missing": lambda c, yes: missing(c) if yes else present(c), "between": lambda c, ends: within(c, *ends),
}


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | _known(c)
    return out


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & _known(c)
    return out
