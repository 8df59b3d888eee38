"""Scalar column helpers with NULL-safe semantics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F


def num(name_or_col) -> Column:
    return F.col(name_or_col) if isinstance(name_or_col, str) else name_or_col


def clip(x: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL: greatest/least alone would skip it and return a bound."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo))))


def at_least(x: Column, lo: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(lo))))


def ratio(a: Column, b: Column) -> Column:
    """a / b with NULL where b is zero."""
    return F.try_divide(a, b)


def flag(cond: Column) -> Column:
    """A comparison with a missing operand counts as false."""
    return F.coalesce(cond, F.lit(False))


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, list(conds))


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, list(conds))


def row_sum(cols) -> Column:
    """Sum over columns with NULL skipped; all NULL gives 0."""
    return reduce(lambda a, b: a + b, [zero(num(c)) for c in cols])


def row_mean(cols) -> Column:
    """Mean over columns with NULL skipped; all NULL gives NULL."""
    present = reduce(lambda a, b: a + b, [num(c).isNotNull().cast("int") for c in cols])
    return F.try_divide(row_sum(cols), present)


def cyclical(x: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * x / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def finite(x: Column) -> Column:
    """Infinities and NaN become NULL."""
    bad = F.isnan(x) | (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))
    return F.when(~bad, x)


def decision_label(x: Column, long_above: float, short_below: float) -> Column:
    """LONG / SHORT / HOLD by strict comparison; missing counts as HOLD."""
    return (
        F.when(x > F.lit(float(long_above)), F.lit("LONG"))
        .when(x < F.lit(float(short_below)), F.lit("SHORT"))
        .otherwise(F.lit("HOLD"))
    )


def position_label(x: Column, tolerance: float = 1e-6) -> Column:
    return decision_label(x, tolerance, -tolerance)


def utc(ts: Column, zone: str | None = None) -> Column:
    """Naive or zoned wall-clock time to an instant; the session time zone is UTC."""
    ts = ts.cast("timestamp")
    return F.to_utc_timestamp(ts, zone) if zone else ts


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)
