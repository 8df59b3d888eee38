"""Quantiles over a series, over a rolling frame and over all rows so far, none of them in one task per series.

- :func:`quantile` brackets the wanted value by a sketch, counts what lies below the bracket and narrows it until
  few distinct values remain. Only those are sorted.
- :func:`rolling_quantiles` keeps an ordered window per (series, chunk) instead of sorting a frame for every row.
- :func:`expanding_median` takes from all earlier chunks only the middle values that the medians of a chunk can reach.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import DEFAULT_CHUNKING
from . import chunks
from .staging import stage

#: A group with more values than this is narrowed before its values are sorted.
GATHER = 100_000
#: Points of the sketch; its error in rank is a tenth of the distance of two points.
GRID = 256
ACCURACY = 10 * GRID


def _rank(q: float, n: Column) -> Column:
    return F.lit(float(q)) * (n - 1)


def quantile(
    df: DataFrame, keys, ts: str, value: Column, q: float, name: str, gather: int = GATHER, grid: int = GRID
) -> DataFrame:
    """(keys, name): the exact quantile of the non-null values of each group, interpolated between neighbours.

    ``df`` may be chunked or not; it is read once and only keys and value are staged. Groups without a value are
    left out. Ties cost nothing: what is sorted are distinct values with their counts.
    """
    keys = list(keys)
    chunk = F.col(chunks.CHUNK) if chunks.CHUNK in df.columns else F.floor(chunks.hour_index(ts) / DEFAULT_CHUNKING.rows)
    rows = stage(df.select(*keys, chunk.alias(chunks.CHUNK), value.cast("double").alias("_x")).where(F.col("_x").isNotNull()))
    bracket = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double"), "_below": F.lit(0).cast("long"), "_in": F.col("_n")}
    )
    before, narrowed = None, False
    while True:
        most = bracket.agg(F.max("_in")).first()[0] or 0
        if most <= gather or (before is not None and most >= before):
            break
        bracket, before, narrowed = stage(_narrow(rows, bracket, keys, ts, q, gather, grid)), most, True
    if narrowed:
        kept = chunks.attach(rows, bracket, keys, ts, "inner").where(_inside(F.col("_lo"), F.col("_hi")))
        values = kept.groupBy(*keys, "_n", "_below", "_x").agg(F.count(F.lit(1)).alias("_c"))
        n, below = F.col("_n"), F.col("_below")
    else:
        values = rows.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
        n, below = F.sum("_c").over(Window.partitionBy(*keys)), F.lit(0)
    w = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumns({"_through": below + F.sum("_c").over(w), "_at": _rank(q, n)})
    first = lambda rank: F.min(F.when(F.col("_through") > rank, F.col("_x")))
    out = values.groupBy(*keys).agg(
        first(F.floor("_at")).alias("_a"), first(F.ceil("_at")).alias("_b"), F.max(F.col("_at") - F.floor("_at")).alias("_part")
    )
    return out.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * (1 - F.col("_part")) + F.col("_b") * F.col("_part")).alias(name))


def _inside(lo: Column, hi: Column) -> Column:
    x = F.col("_x")
    return (lo.isNull() | (x >= lo)) & (hi.isNull() | (x <= hi))


def _narrow(rows: DataFrame, bracket: DataFrame, keys, ts: str, q: float, gather: int, grid: int) -> DataFrame:
    """The next bracket of each large group: two points of a sketch of its present one, and counts that prove it."""
    large = chunks.attach(rows, bracket.where(F.col("_in") > gather), keys, ts, "inner")
    points = F.approx_percentile("_x", F.array(*[F.lit(i / grid) for i in range(grid + 1)]), F.lit(10 * grid))
    sketch = large.where(_inside(F.col("_lo"), F.col("_hi"))).groupBy(*keys).agg(points.alias("_points"))
    at = _rank(q, F.col("_n"))
    share = lambda rank: (rank - F.col("_below")) / F.col("_in") * grid
    left, right = F.floor(share(F.floor(at))) - 1, F.ceil(share(F.ceil(at) + 1)) + 1
    point = lambda i: F.get("_points", i.cast("int"))
    asked = bracket.join(sketch, keys).select(
        *keys, "_n", F.col("_lo").alias("_lo0"), F.col("_hi").alias("_hi0"), F.col("_below").alias("_below0"), F.col("_in").alias("_in0"),
        F.when(left > 0, point(left)).otherwise(F.col("_lo")).alias("_lo"), F.when(right < grid, point(right)).otherwise(F.col("_hi")).alias("_hi"),
    )
    tried = chunks.attach(rows, asked, keys, ts, "inner").groupBy(*keys, "_n", "_lo0", "_hi0", "_below0", "_in0", "_lo", "_hi").agg(
        F.count_if(F.col("_x") < F.col("_lo")).alias("_below"), F.count_if(_inside(F.col("_lo"), F.col("_hi"))).alias("_in")
    )
    right_one = (F.col("_below") <= F.floor(at)) & (F.col("_below") + F.col("_in") > F.ceil(at))
    # Where the sketch was wrong the old bracket stays.
    narrow = tried.select(*keys, "_n", *[F.when(right_one, F.col(c)).otherwise(F.col(f"{c}0")).alias(c) for c in ("_lo", "_hi", "_below", "_in")])
    return bracket.where(F.col("_in") <= gather).unionByName(narrow)


def rolling_quantiles(df: DataFrame, group, ts: str, specs: dict[str, tuple[str, float, int, int]]) -> DataFrame:
    """Add columns name -> (column, q, size, min_n): the quantile of the last ``size`` rows with ``min_n`` values at least.

    ``group`` is (keys, chunk); the halo of a chunk reaches ``size`` rows back. Each group is one Arrow table that
    passes an ordered window row by row; a row costs the logarithm of the window, not a sort of it.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in specs]])

    def roll(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(ts, "ascending")]))
        for name, (column, q, size, least) in specs.items():
            window = pd.Series(table.column(column).to_numpy(zero_copy_only=False), dtype=float).rolling(size, min_periods=least)
            got = (window.median() if q == 0.5 else window.quantile(q)).to_numpy()
            table = table.append_column(name, pa.array(got, pa.float64(), from_pandas=True))
        return table

    return df.groupBy(*group).applyInArrow(roll, schema)


# ---------------------------------------------------------------- all rows so far


class Middle:
    """The middle of a growing collection: its values around the median, and how many lie below and above them."""

    def __init__(self, values: list[float], below: int, total: int):
        self.values, self.below, self.total = values, below, total
        self.above = total - below - len(values)

    def add(self, x: float) -> None:
        self.total += 1
        if self.values and x < self.values[0] and self.below:
            self.below += 1
        elif self.values and x > self.values[-1] and self.above:
            self.above += 1
        else:
            bisect.insort(self.values, x)

    def median(self) -> float:
        if not self.total:
            return float("nan")
        a, b = self.values[(self.total - 1) // 2 - self.below], self.values[self.total // 2 - self.below]
        return (a + b) / 2.0


def reach(total, own):
    """Ranks among ``total`` earlier values between which medians can lie while ``own`` values are added."""
    return (total - own) // 2 - 2, (total + own) // 2 + 2


def _medians(own: pd.DataFrame, ts: str, middle: Middle) -> np.ndarray:
    out = np.full(len(own), np.nan)
    for i, x in enumerate(own["_x"].to_numpy(dtype=float)):
        if x == x:
            middle.add(x)
        out[i] = middle.median()
    return out


def _cut(values: np.ndarray, counts: np.ndarray, below: int, total: int, own: int) -> Middle:
    """The middle from distinct values with counts, cut to the ranks that can be reached."""
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    low, high = reach(total, own)
    starts = below + np.cumsum(counts) - counts
    first, last = np.maximum(starts, low), np.minimum(starts + counts, high + 1)
    kept = np.maximum(last - first, 0)
    below = int(first[np.argmax(kept > 0)]) if kept.any() else below
    return Middle(np.repeat(values, kept).tolist(), below, total)


def expanding_median(df: DataFrame, keys, ts: str, value: str, name: str, grid: int = GRID) -> DataFrame:
    """(keys, chunk, ts, name): the median of all values of the series up to and with each row; null before the first.

    ``df`` is chunked without halo and staged. Values are counted per range of value and chunk; a prefix over the
    chunks tells, for every chunk, which ranges hold the ranks that its medians can reach. Only the earlier values
    of these ranges are brought to the chunk: about as many as it has rows, plus the rest of two ranges.
    """
    keys, k = list(keys), chunks.chunk_keys(keys)
    own = df.select(*k, F.col(ts).alias("_t"), F.col(value).cast("double").alias("_x"))
    group = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("_x").schema.fields)
    schema = f"{group}, `{name}` double"

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        pdf[name] = _medians(pdf, "_t", Middle([], 0, 0))
        return pdf.drop(columns=["_x"])

    def later(pdf: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        if earlier.empty:
            return alone(pdf)
        if pdf.empty:
            return pd.DataFrame(columns=[*k, "_t", name])
        pdf, e = pdf.sort_values("_t"), earlier.iloc[0]
        values, counts = (np.concatenate([np.asarray(a) for a in e[c]]) for c in ("values", "counts"))
        pdf[name] = _medians(pdf, "_t", _cut(values, counts, int(e["below"]), int(e["total"]), int(pdf["_x"].notna().sum())))
        return pdf.drop(columns=["_x"])

    spans = df.groupBy(*keys).agg(F.count_distinct(chunks.CHUNK).alias("n"))
    if (spans.agg(F.max("n")).first()[0] or 0) <= 1:
        out = own.groupBy(*k).applyInPandas(alone, schema)
    else:
        earlier = _earlier(own.drop("_t"), keys, k, grid)
        earlier = earlier.select(*[F.col(c).alias(c) for c in earlier.columns])  # columns of their own, for the cogroup
        out = own.groupBy(*k).cogroup(earlier.groupBy(*k)).applyInPandas(later, schema)
    return out.select(*k, F.col("_t").alias(ts), F.when(~F.isnan(name), F.col(name)).alias(name))


def _earlier(own: DataFrame, keys: list[str], k: list[str], grid: int) -> DataFrame:
    """Per chunk: total and below (counts of earlier values), and the distinct values of the ranges it can reach."""
    points = F.approx_percentile("_x", F.array(*[F.lit(i / grid) for i in range(1, grid)]), F.lit(10 * grid))
    cuts = own.groupBy(*keys).agg(points.alias("_points"))
    placed = chunks.attach(own.where(F.col("_x").isNotNull()), cuts, keys, "_x")
    placed = placed.withColumn("range", F.size(F.filter("_points", lambda p: p <= F.col("_x")))).drop("_points")
    distinct = placed.groupBy(*k, "range", "_x").agg(F.count(F.lit(1)).alias("c"))
    held = stage(
        distinct.groupBy(*k, "range").agg(F.collect_list("_x").alias("values"), F.collect_list("c").alias("counts"), F.sum("c").alias("n"))
    )
    sizes = own.groupBy(*k).agg(F.count("_x").alias("own"))
    table = sizes.join(held.select(*keys, "range").distinct(), keys).join(held.select(*k, "range", "n"), [*k, "range"], "left")
    past = Window.partitionBy(*keys, "range").orderBy(chunks.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(*k).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0))).withColumns(
        {"through": F.sum("before").over(ranges), "total": F.sum("before").over(Window.partitionBy(*k))}
    )
    low, high = F.floor((F.col("total") - F.col("own")) / 2) - 2, F.floor((F.col("total") + F.col("own")) / 2) + 2
    needed = table.where((F.col("before") > 0) & (F.col("through") > low) & (F.col("through") - F.col("before") <= high))
    needed = needed.select(*k, "range", "total", (F.col("through") - F.col("before")).alias("below"))
    pieces = held.withColumnRenamed(chunks.CHUNK, "_from").join(needed, [*keys, "range"]).where(F.col("_from") < F.col(chunks.CHUNK))
    return pieces.groupBy(*k).agg(
        F.min("below").alias("below"), F.max("total").alias("total"), F.collect_list("values").alias("values"), F.collect_list("counts").alias("counts")
    )
