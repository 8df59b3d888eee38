"""The research workflow: refresh, clean, features, scored rows, backtests, comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT_CHUNKING, BacktestConfig, Chunking, ForecastConfig
from ..functions.staging import stage
from ..operators import baselines, compare, forecast, gaps, quality
from ..operators.features import build_features
from ..operators.joins import join_energy_weather, require_rows
from ..functions import chunks
from ..functions.windows import ordered
from ..schema import (
    ENERGY_REQUIRED, ENERGY_VALUES, FEATURE_REQUIRED, FETCHED, IS_SYNTHETIC, KEYS, QUALITY, TS, WEATHER_VALUES,
)


@dataclass(frozen=True)
class Refresh:
    panel: DataFrame
    provenance: DataFrame
    diagnostics: DataFrame
    ranges: DataFrame
    failed: DataFrame | None = None


def seasonal_fallback(
    df: DataFrame, values, keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """Fallback values for missing cells: the causal weekday-and-hour profile of each series."""
    part = chunks.split(df.select(*keys, ts, *values), ts, back=1, chunking=chunking)
    w = ordered(chunks.chunk_keys(keys), ts)
    part = chunks.core(part.withColumns({f"_lag_{c}": F.lag(c).over(w) for c in values}), keep_chunk=True)
    out = baselines.seasonal_profile(
        part, {f"_fill_{c}": F.col(c) for c in values}, {f"_fill_{c}": F.col(f"_lag_{c}") for c in values}, keys, ts
    )
    return out.select(*keys, ts, *[F.col(f"_fill_{c}").alias(c) for c in values])


def refresh_panel(
    existing: DataFrame,
    series: DataFrame,
    start: str,
    end: str,
    fetch: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]],
    source: str,
    fetched_at: Column,
    values=ENERGY_VALUES,
    required=ENERGY_REQUIRED,
    fallback: Callable[[DataFrame], DataFrame] | None = None,
    keys=KEYS,
    ts: str = TS,
    force: bool = False,
) -> Refresh:
    """Bring the panel of every series in ``series`` up to date over [start, end].

    Only missing ranges go to ``fetch`` (ranges in, raw rows out, or raw rows and the ranges that failed, as
    ``ranges.fetch_ranges`` gives). New rows are rolled up, stamped and merged by quality; what is still missing
    comes from ``fallback`` and is labelled so.
    """
    bounds = series.select(*keys).distinct().withColumns(
        {"start": F.lit(start).cast("timestamp"), "end": F.lit(end).cast("timestamp")}
    )
    grid = gaps.hourly_grid(bounds, keys=keys, ts=ts)
    wanted = existing.where(F.lit(not force))
    asked = stage(gaps.align_to_grid(grid, wanted, keys, ts))
    ranges = stage(gaps.missing_ranges(asked, required, keys, ts, force))
    got = fetch(ranges)
    raw, failed = got if isinstance(got, tuple) else (got, None)
    raw = gaps.rollup_hourly(raw, [c for c in values], keys, ts)
    fresh = quality.annotate_source(raw.join(grid, [*keys, ts], "left_semi"), required, source, fetched_at)
    merged = quality.upsert_by_quality(
        asked.unionByName(fresh, allowMissingColumns=True), keys, ts, tie_break=[IS_SYNTHETIC, *values]
    )
    merged = stage(merged)
    side = (fallback or (lambda df: seasonal_fallback(df, values, keys, ts)))(merged)
    resolved = stage(
        quality.fill_from_fallback(merged, side, values, required, f"{source}_synthetic", fetched_at, keys, ts)
    )
    inside = F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    outside = existing.where(~F.coalesce(inside, F.lit(False)))
    diagnostics = quality.refresh_diagnostics(
        merged, existing, fresh, ranges, resolved, required, start, end, keys, ts, force, failed
    )
    return Refresh(
        outside.unionByName(resolved, allowMissingColumns=True), quality.provenance_summary(resolved, keys), diagnostics,
        ranges, failed,
    )


def clean_panel(
    df: DataFrame, values, keys=KEYS, ts: str = TS, energy: bool = True, chunking: Chunking = DEFAULT_CHUNKING,
    order=None, causal: bool = False,
) -> DataFrame:
    """Coerce, dedupe, repair gaps, resolve price fallbacks and mark repaired rows."""
    typed = quality.coerce_types(df, values, ts).where(F.col(ts).isNotNull())
    typed = quality.dedupe_first(typed, order or [FETCHED], keys, ts)
    filled = gaps.interpolate_and_fill(typed, list(values), keys, ts, chunking=chunking, causal=causal)
    if energy:
        filled = gaps.resolve_prices(filled)
    return gaps.mark_repaired(filled) if QUALITY in filled.columns else filled


def feature_table(
    energy: DataFrame, weather: DataFrame, keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """Clean both panels, join them, build features."""
    joined = join_energy_weather(
        clean_panel(energy, ENERGY_VALUES, keys, ts, True, chunking).drop("had_gap"),
        clean_panel(weather, WEATHER_VALUES, keys, ts, False, chunking).drop("had_gap"),
        keys, ts,
    )
    joined = stage(joined)
    require_rows(joined, "energy and weather share no hours")
    shares = quality.require_input(joined, FEATURE_REQUIRED, keys=keys)
    return build_features(joined, keys, ts, chunking, shares)


def research_run(
    features: DataFrame, model_key: str, bc: BacktestConfig = BacktestConfig(), fc: ForecastConfig = ForecastConfig(),
    keys=KEYS, ts: str = TS, provenance: DataFrame | None = None, **options,
) -> dict[str, DataFrame]:
    """Train one model, score it, and compare its strategies with all baselines."""
    scored = stage(forecast.train_with_model(model_key, features, fc, keys, ts, **options))
    table, significance = compare.compare_strategies(scored, bc, fc, keys, ts, provenance=provenance)
    return {"scored": scored, "strategies": table, "significance": significance}
