"""Computed values: arithmetic that never fails, CASE, coercions, time bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.predicates import column


def value(x) -> Column:
    """A column by name or as it is; numbers as literals."""
    return column(x) if isinstance(x, (str, Column)) else F.lit(x)


def add(a, b) -> Column:
    return value(a) + value(b)


def subtract(a, b) -> Column:
    return value(a) - value(b)


def multiply(a, b) -> Column:
    return value(a) * value(b)


def divide(a, b) -> Column:
    """Always a double; 0.0 where the divisor is zero."""
    a, b = value(a).cast("double"), value(b).cast("double")
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def modulo(a, b) -> Column:
    """The remainder with the dividend's sign; 0 where the divisor is zero."""
    a, b = value(a), value(b)
    return F.when(b == 0, F.lit(0)).otherwise(F.try_mod(a, b))


def absolute(a) -> Column:
    return F.abs(value(a))


def round_(a) -> Column:
    """Half away from zero."""
    return F.round(value(a))


def floor(a) -> Column:
    return F.floor(value(a)).cast("double")


def ceil(a) -> Column:
    return F.ceil(value(a)).cast("double")


def sqrt(a) -> Column:
    """0.0 for negative values."""
    a = value(a).cast("double")
    return F.when(a < 0, F.lit(0.0)).otherwise(F.sqrt(a))


def power(a, b) -> Column:
    return F.pow(value(a).cast("double"), value(b).cast("double"))


def larger(a, b) -> Column:
    """Missing if either is."""
    a, b = value(a), value(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def smaller(a, b) -> Column:
    a, b = value(a), value(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def case(clauses: list[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first condition that holds; without ELSE, missing."""
    if not clauses:
        raise ValueError("CASE needs a clause")
    out = None
    for condition, result in clauses:
        result = result if isinstance(result, Column) else F.lit(result)
        out = F.when(condition, result) if out is None else out.when(condition, result)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def with_default(c, default) -> Column:
    return F.coalesce(column(c), F.lit(default))


def as_type(c, kind: str) -> Column:
    """Missing where the value can't be read as the type."""
    return column(c).try_cast(kind)


BINS = ("hour", "day", "week", "month", "year")


def time_bin(c, unit: str) -> Column:
    """The start of the hour, day, week (from Monday), month or year."""
    if unit not in BINS:
        raise ValueError(f"no such bin: {unit}; one of {', '.join(BINS)}")
    return F.date_trunc(unit, column(c)).cast("timestamp_ntz")


#: Seconds from 1970 to 2001, the origin of times as numbers.
ORIGIN = 978_307_200


def seconds_since_2001(c) -> Column:
    """A time as a number, for comparison with numbers."""
    return F.unix_micros(column(c).cast("timestamp")) / 1_000_000.0 - ORIGIN


def time_since_2001(c) -> Column:
    return F.timestamp_micros(((column(c).cast("double") + ORIGIN) * 1_000_000).cast("long")).cast("timestamp_ntz")


def same_time(a, b) -> Column:
    """Equal within a millisecond."""
    return F.abs(seconds_since_2001(a) - seconds_since_2001(b)) < 0.001


def truth(c) -> Column:
    """Booleans as they are; numbers other than zero are true."""
    return column(c).cast("double") != 0
