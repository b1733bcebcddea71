"""Column builders with the reference semantics of missing values: null and NaN are missing, two-valued logic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(c: Column) -> Column:
    """Numeric value or null; text that is no number is null."""
    return c.try_cast("double")


def notna(c: Column) -> Column:
    d = c.try_cast("double")
    return c.isNotNull() & ~F.coalesce(F.isnan(d), F.lit(False))


def present(c: Column) -> Column:
    """The number, with NaN as null."""
    return F.when(~F.isnan(num(c)), num(c))


def mean0(c: Column) -> Column:
    """Mean of the numbers, 0 without any; NaN propagates."""
    return F.coalesce(F.avg(num(c)), F.lit(0.0))


def sum0(c: Column) -> Column:
    return F.coalesce(F.sum(present(c)), F.lit(0.0))


def min_valid(c: Column) -> Column:
    return F.min(present(c))


def max_valid(c: Column) -> Column:
    return F.max(present(c))


def safe_div(a: Column, b: Column) -> Column:
    """0 where the divisor is zero or a side is missing."""
    return F.coalesce(F.try_divide(num(a), num(b)), F.lit(0.0))


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def true(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def both(*cs: Column) -> Column:
    return reduce(lambda a, b: a & b, map(true, cs))


def either(*cs: Column) -> Column:
    return reduce(lambda a, b: a | b, map(true, cs))


def clip(c: Column, lower=None, upper=None) -> Column:
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c.isNotNull(), out)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a costly value, computed once however often it is named."""
    return F.get(F.transform(F.array(c), use), 0)


def clamp01(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


def sigmoid(z: Column, bound: float = 35.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(z, -bound, bound)))


def one_to_five(c: Column) -> Column:
    """Rounded half to even, within 1 to 5."""
    return clip(F.bround(c, 0), 1.0, 5.0).cast("int")


def is_numeric(c: Column) -> Column:
    """Aggregate: whether all values that are there are numbers."""
    return F.coalesce(F.bool_and(F.when(c.isNotNull(), num(c).isNotNull())), F.lit(True))
