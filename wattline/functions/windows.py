"""Row-frame windows with a minimum count of non-null values."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def ordered(keys, ts: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def past(w: WindowSpec, include_current: bool = True) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)


def _guarded(x: Column, value, frame: WindowSpec, min_n: int) -> Column:
    return F.when(F.count(x).over(frame) >= min_n, value.over(frame))


def rolling_mean(x: Column, w: WindowSpec, size: int, min_n: int | None = None) -> Column:
    return _guarded(x, F.avg(x), w.rowsBetween(1 - size, 0), min_n or size)


def rolling_std(x: Column, w: WindowSpec, size: int, min_n: int | None = None) -> Column:
    return _guarded(x, F.stddev_samp(x), w.rowsBetween(1 - size, 0), min_n or size)


def diff(x: Column, w: WindowSpec, k: int = 1) -> Column:
    return x - F.lag(x, k).over(w)


def zscore(x: Column, w: WindowSpec, size: int, min_n: int) -> Column:
    """Rolling z-score; a zero deviation gives NULL."""
    std = rolling_std(x, w, size, min_n)
    return F.try_divide(x - rolling_mean(x, w, size, min_n), F.nullif(std, F.lit(0.0)))


def pct_change(x: Column, w: WindowSpec) -> Column:
    """x / lag(x) - 1; a move away from zero, infinite as a ratio, counts as 0."""
    prev = F.lag(x).over(w)
    return F.when((prev == 0) & (x != 0), F.lit(0.0)).otherwise(F.try_divide(x, prev) - 1)
