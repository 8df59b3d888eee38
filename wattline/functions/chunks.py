"""Cut long series along time: halo rows for bounded frames, carried summaries for unbounded ones.

A window partitioned by series alone puts a whole series in one task. Here each series is cut
into chunks of the hourly grid. Rows near a cut are copied into the neighbouring chunk (the
halo), so a frame of k rows sees the same rows as in the uncut series. Running aggregates use one
small summary row per chunk, a prefix over those rows, and a join back on (keys, chunk).

Row frames equal hours only on a complete hourly grid. For any other frame number the rows with
:func:`number_rows` and pass that column as ``index``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT_CHUNKING, Chunking
from ..schema import KEYS

CHUNK = "_chunk"
HALO = "_halo"
ROW = "_row"


def hour_index(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(ts) / F.lit(3600))


def split(
    df: DataFrame,
    ts: str,
    back: int = 0,
    ahead: int = 0,
    chunking: Chunking = DEFAULT_CHUNKING,
    index: str | None = None,
    keys=KEYS,
) -> DataFrame:
    """Add ``_chunk`` and ``_halo``; rows within ``back``/``ahead`` of a cut appear on both sides.

    Rows are dealt out by (keys, chunk). Left to itself Spark keeps whatever partitioning by series a
    frame already has, since that also serves windows by chunk, and a series would be one task.
    """
    i = F.col(index) if index else hour_index(ts)
    home = F.floor(i / F.lit(chunking.rows))
    if not back and not ahead:
        return _dealt(df.withColumn(CHUNK, home).withColumn(HALO, F.lit(False)), keys)
    first = F.floor((i - F.lit(ahead)) / F.lit(chunking.rows))
    last = F.floor((i + F.lit(back)) / F.lit(chunking.rows))
    cut = (
        df.withColumn("_home", home)
        .withColumn(CHUNK, F.explode(F.sequence(first, last)))
        .withColumn(HALO, F.col(CHUNK) != F.col("_home"))
        .drop("_home")
    )
    return _dealt(cut, keys)


def _dealt(df: DataFrame, keys) -> DataFrame:
    return df.repartition(*[k for k in keys if k in df.columns], CHUNK)


def core(df: DataFrame, keep_chunk: bool = False) -> DataFrame:
    """Drop the copied rows."""
    out = df.where(~F.col(HALO)).drop(HALO)
    return out if keep_chunk else out.drop(CHUNK)


def chunk_keys(keys) -> list[str]:
    return [*keys, CHUNK]


def _join_back(df: DataFrame, carry: DataFrame, keys, by=()) -> DataFrame:
    return df.join(carry, [*chunk_keys(keys), *by], "left")


def _moments(n: Column, m: Column, s: Column) -> Column:
    return F.struct(n.alias("n"), m.alias("m"), s.alias("s"))


def carry(
    df: DataFrame,
    keys,
    ts: str,
    fills: dict[str, Column] | None = None,
    moments: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    by=(),
    include_current: bool = True,
    source: DataFrame | None = None,
) -> DataFrame:
    """Aggregates over all earlier rows of the series, for a chunked frame without halo.

    ``fills``: last non-null value. ``sums`` / ``maxes``: running total and maximum. ``moments``: adds
    ``<name>_n``, ``<name>_mean`` and ``<name>_std``; chunk summaries (count, mean, squared deviation)
    are merged, so raw squares never cancel. ``by`` adds grouping columns inside the series.
    ``include_current`` = False ends every frame one row earlier. ``source``: the same rows, when they
    are cheaper to summarise than ``df``.

    One summary row per chunk, one prefix over those rows and one join serve all requested columns;
    the join keeps the (keys, chunk) partitioning of ``df``.
    """
    fills, moments, sums, maxes = fills or {}, moments or {}, sums or {}, maxes or {}
    group = [*chunk_keys(keys), *by]
    before = Window.partitionBy(*keys, *by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group).orderBy(ts).rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1
    )
    part, pre, final, parts = [], [], {}, {}
    for n, v in fills.items():
        part.append(F.max_by(v, F.when(v.isNotNull(), F.col(ts))).alias(f"_part_{n}"))
        pre.append(F.last(f"_part_{n}", ignorenulls=True).over(before).alias(f"_pre_{n}"))
        final[n] = F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_pre_{n}"))
    for n, v in sums.items():
        part.append(F.sum(v).alias(f"_part_{n}"))
        pre.append(F.coalesce(F.sum(f"_part_{n}").over(before), F.lit(0.0)).alias(f"_pre_{n}"))
        final[n] = F.col(f"_pre_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0.0))
    for n, v in maxes.items():
        part.append(F.max(v).alias(f"_part_{n}"))
        pre.append(F.max(f"_part_{n}").over(before).alias(f"_pre_{n}"))
        final[n] = F.greatest(F.col(f"_pre_{n}"), F.max(v).over(inside))
    none = F.lit(0.0)
    for n, v in moments.items():
        part.append(
            _moments(
                F.count(v).cast("double"), F.coalesce(F.avg(v), none), F.coalesce(F.var_pop(v) * F.count(v), none)
            ).alias(f"_part_{n}")
        )
        p = F.col(f"_part_{n}")
        cnt = F.coalesce(F.sum(p["n"]).over(before), none)
        mean = F.coalesce(F.try_divide(F.sum(p["n"] * p["m"]).over(before), cnt), none)
        sq = F.coalesce(F.sum(p["s"] + p["n"] * p["m"] * p["m"]).over(before), none) - cnt * mean * mean
        pre.append(_moments(cnt, mean, F.greatest(sq, none)).alias(f"_pre_{n}"))
        final[f"_in_{n}"] = _moments(
            F.count(v).over(inside).cast("double"),
            F.coalesce(F.avg(v).over(inside), none),
            F.coalesce(F.var_pop(v).over(inside), none),
        )
        a, b = F.col(f"_pre_{n}"), F.col(f"_in_{n}")
        total, gap = a["n"] + b["n"], b["m"] - a["m"]
        spread = a["s"] + b["s"] * b["n"] + gap * gap * F.coalesce(F.try_divide(a["n"] * b["n"], total), none)
        parts[f"{n}_n"] = total
        parts[f"{n}_mean"] = F.when(total > 0, a["m"] + gap * F.try_divide(b["n"], total))
        parts[f"{n}_std"] = F.when(total > 1, F.sqrt(F.try_divide(spread, total - 1)))
    summary = (df if source is None else source).groupBy(*group).agg(*part)
    out = _join_back(df, summary.select(*group, *pre), keys, by).withColumns(final)
    if parts:
        out = out.withColumns(parts)
    names = [*fills, *sums, *maxes, *moments]
    return out.drop(*[f"_pre_{n}" for n in names], *[f"_in_{n}" for n in moments])


def attach(df: DataFrame, per_series: DataFrame, keys, ts: str, how: str = "left") -> DataFrame:
    """Join a table of one row per series without gathering a series in one task.

    The small side is repeated once per chunk of its series and joined on (keys, chunk).
    """
    chunked = CHUNK in df.columns
    big = df if chunked else split(df, ts).drop(HALO)
    spans = big.groupBy(*keys).agg(F.collect_set(CHUNK).alias("_chunks"))
    small = per_series.join(spans, list(keys)).withColumn(CHUNK, F.explode("_chunks")).drop("_chunks")
    out = big.join(small, chunk_keys(keys), how)
    return out if chunked else out.drop(CHUNK)


def next_valid(df: DataFrame, keys, ts: str, cols) -> DataFrame:
    """Add ``_next_<col>``: struct(ts, value) of the nearest later non-null row of the series.

    ``df`` is chunked and may carry halo rows; only home rows enter the chunk summary.
    """
    home = ~F.col(HALO)
    head = df.groupBy(*chunk_keys(keys)).agg(
        *[
            F.min(F.when(home & F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v")))).alias(
                f"_head_{c}"
            )
            for c in cols
        ]
    )
    later = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = head.select(
        *chunk_keys(keys),
        *[F.last(f"_head_{c}", ignorenulls=True).over(later).alias(f"_later_{c}") for c in cols],
    )
    # Reading the chunk backwards keeps the frame O(1) per row; an unbounded-following frame is O(n).
    back = (
        Window.partitionBy(*chunk_keys(keys)).orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    point = {
        c: F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v"))) for c in cols
    }
    out = _join_back(df, carry, keys)
    out = out.withColumns(
        {f"_next_{c}": F.coalesce(F.last(p, ignorenulls=True).over(back), F.col(f"_later_{c}")) for c, p in point.items()}
    )
    return out.drop(*[f"_later_{c}" for c in cols])


def number_rows(
    df: DataFrame, keys, ts: str, out: str = ROW, chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """0-based row number of each row within its series, without one task per series.

    Rows are numbered inside time buckets and shifted by the count of earlier buckets.
    """
    bucketed = split(df, ts, chunking=chunking).drop(HALO)
    sizes = bucketed.groupBy(*chunk_keys(keys)).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *chunk_keys(keys), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    w = Window.partitionBy(*chunk_keys(keys)).orderBy(ts)
    return (
        _join_back(bucketed, offsets, keys)
        .withColumn(out, (F.col("_offset") + F.row_number().over(w) - 1).cast("long"))
        .drop("_offset", CHUNK)
    )
