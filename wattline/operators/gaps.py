"""Hourly grid, coverage gaps and gap repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT_CHUNKING, Chunking
from ..functions import chunks
from ..functions.columns import all_of, any_of, flag, hour_of
from ..schema import DAY_AHEAD, FETCHED, INTRADAY, IS_SYNTHETIC, KEYS, PRICE, QUALITY, SOURCE, SPREAD, TS

def one_hour() -> Column:
    return F.make_dt_interval(hours=F.lit(1))



def rollup_hourly(df: DataFrame, cols, keys=KEYS, ts: str = TS) -> DataFrame:
    """Mean of each value column per hour. Without value columns: the distinct hours.

    A plain grouped mean: Spark aggregates before the shuffle, so one series with most of the
    raw rows still sends only one partial row per hour and task.
    """
    hourly = df.withColumn(ts, hour_of(F.col(ts)))
    if not cols:
        return hourly.where(F.col(ts).isNotNull()).select(*keys, ts).distinct()
    return hourly.groupBy(*keys, ts).agg(*[F.avg(c).alias(c) for c in cols])


def hourly_grid(bounds: DataFrame, start: str = "start", end: str = "end", keys=KEYS, ts: str = TS) -> DataFrame:
    """Every hour from start to end inclusive, one row per series and hour."""
    days = F.sequence(F.date_trunc("day", F.col(start)), F.col(end), F.expr("INTERVAL 1 DAY"))
    # Two steps: a row never carries more than one day of hours, however long the range is.
    daily = bounds.select(*keys, start, end, F.explode(days).alias("_day"))
    base = F.col(start) + F.make_dt_interval(hours=24 * F.datediff(F.col("_day"), F.col(start)))
    return (
        daily.select(*keys, end, F.explode(F.sequence(base, base + F.expr("INTERVAL 23 HOUR"), one_hour())).alias(ts))
        .where(F.col(ts) <= F.col(end))
        .select(*keys, ts)
    )


def series_bounds(df: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def align_to_grid(grid: DataFrame, df: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    return grid.join(df, [*keys, ts], "left")


def needs_fetch(required, force: bool = False) -> Column:
    """A row is covered only when its quality is real and every required value is present."""
    if force:
        return F.lit(True)
    return ~(flag(F.col(QUALITY) == "real") & all_of(F.col(c).isNotNull() for c in required))


def missing_ranges(
    df: DataFrame, required, keys=KEYS, ts: str = TS, force: bool = False, chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """Runs of uncovered hours as [range_start, range_end); a step over one hour starts a new run.

    Only uncovered rows survive the filter. Each chunk is reduced to its runs, and only its first and last
    run can go on across a cut: runs in between are final, and what meets per series are two rows a chunk.
    """
    bad = df.where(needs_fetch(required, force)).select(*keys, ts)
    hours = bad.withColumns({"range_start": F.col(ts), "range_end": F.col(ts) + one_hour()})
    inside = chunks.chunk_keys(keys)
    runs = _merge_runs(chunks.split(hours, ts, chunking=chunking, keys=keys), inside)
    w = Window.partitionBy(*inside).orderBy("range_start")
    runs = runs.withColumn("_edge", F.lag("range_start").over(w).isNull() | F.lead("range_start").over(w).isNull())
    ranges = [*keys, "range_start", "range_end"]
    edges = _merge_runs(runs.where("_edge"), keys)
    return edges.select(*ranges).unionByName(runs.where("NOT _edge").select(*ranges))


def _merge_runs(df: DataFrame, keys) -> DataFrame:
    """Merge [range_start, range_end) rows of a group that touch or overlap."""
    w = Window.partitionBy(*keys).orderBy("range_start")
    seen = F.max("range_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce((F.col("range_start") > seen).cast("int"), F.lit(1))
    return (
        df.withColumn("_new", start)
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end"))
        .drop("_run")
    )


def chunk_ranges(ranges: DataFrame, days: int, keys=KEYS) -> DataFrame:
    """Split each range into consecutive pieces of at most ``days`` days."""
    step = F.expr(f"INTERVAL {max(1, int(days))} DAY")
    starts = F.sequence(F.col("range_start"), F.col("range_end"), step)
    return (
        ranges.where(F.col("range_start") < F.col("range_end"))
        .select(*keys, F.explode(starts).alias("chunk_start"), "range_end")
        .where(F.col("chunk_start") < F.col("range_end"))
        .select(*keys, "chunk_start", F.least(F.col("chunk_start") + step, F.col("range_end")).alias("chunk_end"))
    )


def bisect_ranges(ranges: DataFrame, keys=KEYS, failed: Column | None = None) -> DataFrame:
    """Halve failed ranges at the next full hour after the midpoint.

    A range of at most one day, or one whose midpoint is not strictly inside, is dropped: it can not
    be split further. Ranges that did not fail pass unchanged.
    """
    failed = F.lit(True) if failed is None else flag(failed)
    lo, hi = F.unix_micros("range_start"), F.unix_micros("range_end")
    hour = F.lit(3600 * 1000000)
    mid_us = F.ceil((lo + (hi - lo) / F.lit(2)) / hour) * hour
    mid = F.timestamp_micros(mid_us.cast("long"))
    can_split = ((hi - lo) > F.lit(24) * hour) & (mid_us > lo) & (mid_us < hi)
    span = lambda a, b: F.struct(a.alias("range_start"), b.alias("range_end"))
    start, end = F.col("range_start"), F.col("range_end")
    none = F.filter(F.array(span(start, end)), lambda _: F.lit(False))
    parts = (
        F.when(~failed, F.array(span(start, end)))
        .when(can_split, F.array(span(start, mid), span(mid, end)))
        .otherwise(none)
    )
    return ranges.select(*keys, F.inline(parts))


def interpolate_and_fill(
    df: DataFrame,
    cols,
    keys=KEYS,
    ts: str = TS,
    interpolate: int = 6,
    ffill: int = 3,
    bfill: int = 3,
    chunking: Chunking = DEFAULT_CHUNKING,
    causal: bool = False,
) -> DataFrame:
    """Linear-in-time fill, then hold forward, then back-fill, each limited per gap.

    Adds ``had_gap``: the row had a NULL in ``cols`` before the fill. A gap at the end takes the
    last value; one at the start is only back-filled. ``causal`` keeps the forward fill alone.
    """
    back = (0 if causal else interpolate) + ffill + bfill
    part = chunks.split(df, ts, back=back, ahead=0 if causal else bfill, chunking=chunking)
    part = part.withColumn("had_gap", any_of(F.col(c).isNull() for c in cols))
    w = Window.partitionBy(*chunks.chunk_keys(keys)).orderBy(ts)
    if not causal:
        part = chunks.next_valid(part, keys, ts, cols)
        recent = w.rowsBetween(-interpolate, -1)
        prev = {
            f"_prev_{c}": F.last(
                F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v"))), ignorenulls=True
            ).over(recent)
            for c in cols
        }
        part = part.withColumns(prev)
        filled = {}
        for c in cols:
            a, b = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
            at = F.unix_micros(ts) - F.unix_micros(a["t"])
            span = F.unix_micros(b["t"]) - F.unix_micros(a["t"])
            line = F.coalesce(a["v"] + (b["v"] - a["v"]) * F.try_divide(at, span), a["v"])
            filled[c] = F.coalesce(F.col(c), line)
        part = part.withColumns(filled).drop(*[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols])
    if ffill:
        hold = w.rowsBetween(-ffill, 0)
        part = part.withColumns({c: F.last(c, ignorenulls=True).over(hold) for c in cols})
    if bfill and not causal:
        lead = w.rowsBetween(0, bfill)
        part = part.withColumns({c: F.first(c, ignorenulls=True).over(lead) for c in cols})
    return chunks.core(part)


def resolve_prices(df: DataFrame) -> DataFrame:
    """Fill day-ahead and intraday from the price, re-derive the price, and recompute the spread."""
    da = F.coalesce(DAY_AHEAD, PRICE)
    intra = F.coalesce(INTRADAY, PRICE)
    return df.withColumns(
        {DAY_AHEAD: da, INTRADAY: intra, PRICE: F.coalesce(intra, da, F.col(PRICE)), SPREAD: intra - da}
    )


def mark_repaired(df: DataFrame, repaired: Column | str = "had_gap") -> DataFrame:
    """Lower the quality of repaired rows and keep the source label consistent with it."""
    repaired = F.col(repaired) if isinstance(repaired, str) else repaired
    quality = F.when(repaired & flag(F.col(QUALITY) == "real"), F.lit("partially_synthetic")).otherwise(F.col(QUALITY))
    source = F.coalesce(SOURCE, F.lit("unknown"))
    source = F.when(flag(quality == "synthetic") & (source == "unknown"), F.lit("synthetic")).otherwise(source)
    return df.withColumns({QUALITY: quality, IS_SYNTHETIC: ~flag(quality == "real"), SOURCE: source})


def freshness(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(FETCHED).alias("freshest_fetch_utc"))
