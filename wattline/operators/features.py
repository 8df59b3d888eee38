"""Causal feature builder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..config import DEFAULT_CHUNKING, Chunking
from ..functions import chunks
from ..functions.columns import all_of, cyclical, finite, flag, zero
from ..functions.staging import stage
from ..functions.order_stats import rolling_quantiles
from ..functions.windows import diff, ordered, pct_change, rolling_mean, rolling_std, zscore
from ..schema import (
    DAY_AHEAD, DEMAND, IMBALANCE, INTRADAY, KEYS, PRICE, RENEWABLE, RENEWABLE_FORECAST, SPREAD, TS, WEATHER_VALUES,
)
from .quality import fill_optional_context

BASE_COLUMNS = (DEMAND, RENEWABLE, PRICE, DAY_AHEAD, INTRADAY, SPREAD, IMBALANCE, "net_load_mw")
# Longest reach of nested frames: a 168-row quantile of a 24-row deviation of a 1-row difference.
HALO_ROWS = 168 + 24 + 1
WINTER_MONTHS = (11, 12, 1, 2)
PEAK_HOURS = (7, 8, 9, 17, 18, 19)


def calendar(df: DataFrame, ts: str = TS) -> DataFrame:
    t = F.col(ts)
    out = df.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t)})
    pairs = {"hour": ("hour", 24), "dow": ("day_of_week", 7), "month": ("month", 12)}
    made = {}
    for short, (col, period) in pairs.items():
        made[f"{short}_sin"], made[f"{short}_cos"] = cyclical(F.col(col), period)
    return out.withColumns(made)


def derived_levels(df: DataFrame) -> DataFrame:
    load_mw = F.col(DEMAND) / 1000.0
    return df.withColumns(
        {
            "net_load_mw": load_mw - F.col(RENEWABLE),
            "renewable_forecast_error_mw": F.col(RENEWABLE_FORECAST) - F.col(RENEWABLE),
            SPREAD: F.col(INTRADAY) - F.col(DAY_AHEAD),
            "renewable_penetration": F.try_divide(F.col(RENEWABLE), load_mw + 1e-6),
            "imbalance_price_spread": F.col(IMBALANCE) - F.col(PRICE),
        }
    )


def lag_roll(df: DataFrame, cols=BASE_COLUMNS, keys=KEYS, ts: str = TS) -> DataFrame:
    """Six columns per base column, all on one window order, so Spark sorts once."""
    w = ordered(keys, ts)
    made = {}
    for c in cols:
        x = F.col(c)
        made[f"{c}_lag_1"] = F.lag(x, 1).over(w)
        made[f"{c}_lag_24"] = F.lag(x, 24).over(w)
        made[f"{c}_roll_mean_24"] = rolling_mean(x, w, 24)
        made[f"{c}_roll_std_24"] = rolling_std(x, w, 24)
        made[f"{c}_ramp_1h"] = diff(x, w, 1)
        made[f"{c}_ramp_24h"] = diff(x, w, 24)
    return df.withColumns(made)


def momentum(df: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """Momentum and ramps; ``price_step`` is kept for the second window stage."""
    w = ordered(keys, ts)
    d = lambda c: diff(F.col(c), w)
    return df.withColumns(
        {
            "price_momentum": pct_change(F.col(PRICE), w),
            "demand_delta": d(DEMAND),
            "demand_ramp_1h": d(DEMAND),
            "renewable_ramp_1h": d(RENEWABLE),
            "price_ramp_1h": d(PRICE),
            "day_ahead_price_ramp_1h": d(DAY_AHEAD),
            "spread_ramp_1h": d(SPREAD),
            "_load_step": d("net_load_mw"),
            "wind_ramp_proxy": zero(d("wind_speed_mps")),
            "solar_shape_proxy": rolling_mean(F.col("radiation_wm2"), w, 3, 1),
            "imbalance_zscore_24": zscore(F.col("net_load_mw"), w, 24, 12),
            "spread_volatility_24": rolling_std(F.col(SPREAD), w, 24, 12),
            **{f"{c}_anomaly": zscore(F.col(c), w, 24, 12) for c in WEATHER_VALUES},
        }
    )


def volatility(df: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """Realised volatility of the price step and its rolling 70% quantile (frames over frames), per group ``keys``."""
    w = ordered(keys, ts)
    out = df.withColumn("realized_volatility_24", rolling_std(F.col("price_ramp_1h"), w, 24, 12))
    return rolling_quantiles(out, keys, ts, {"_vol_q70": ("realized_volatility_24", 0.7, 168, 24)})


def stress_and_interactions(df: DataFrame) -> DataFrame:
    out = df.withColumns(
        {
            "intraday_stress_proxy": F.abs(SPREAD)
            + zero(F.abs("renewable_forecast_error_mw"))
            + zero(F.abs("_load_step")),
            "winter_peak_interaction": (
                F.col("month").isin(*WINTER_MONTHS) & F.col("hour").isin(*PEAK_HOURS)
            ).cast("int"),
        }
    )
    made = {}
    for c in ("net_load_mw", SPREAD, "renewable_forecast_error_mw"):
        made[f"{c}_x_hour_sin"] = zero(F.col(c)) * F.col("hour_sin")
        made[f"{c}_x_dow_cos"] = zero(F.col(c)) * F.col("dow_cos")
    return out.withColumns(made).drop("_load_step")


def windowed_features(
    df: DataFrame, keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """Every feature with a bounded frame; chunked, with ``_vol_q70`` still to be carried forward."""
    part = chunks.split(derived_levels(calendar(df, ts)), ts, back=HALO_ROWS, chunking=chunking)
    k = chunks.chunk_keys(keys)
    part = volatility(momentum(lag_roll(part, keys=k, ts=ts), k, ts), k, ts)
    return stress_and_interactions(chunks.core(part, keep_chunk=True))


def regime_flag(realized: str = "realized_volatility_24", threshold: str = "_vol_q70"):
    return flag(F.col(realized) > F.col(threshold)).cast("int")


def raw_features(df: DataFrame, keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING) -> DataFrame:
    """All feature columns before the final fill, one row per input row."""
    part = windowed_features(df, keys, ts, chunking)
    part = chunks.carry(part, keys, ts, fills={"_vol_q70": F.col("_vol_q70")})
    return part.withColumn("high_vol_regime", regime_flag()).drop("_vol_q70", chunks.CHUNK)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    kinds = (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude]


# Columns that never enter a model.
NON_MODEL = {
    TS, DEMAND, RENEWABLE, PRICE, "data_source", "is_synthetic", "data_quality", "fetch_timestamp_utc", "cache_version",
    "zone", "weather_data_source", "weather_is_synthetic", "weather_data_quality", "weather_fetch_timestamp_utc",
    "weather_cache_version", "weather_zone", "weather_cache_lat", "weather_cache_lon", "weather_lat", "weather_lon",
}


def model_columns(df: DataFrame, keys=KEYS) -> list[str]:
    """Numeric or boolean columns a model may use: no keys, targets, provenance or helper columns."""
    skip = NON_MODEL | set(keys)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in skip and not f.name.startswith("_")
    ]


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns without any value; one aggregate over the frame decides."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, n in counts.items() if n == 0])


def drop_incomplete(df: DataFrame, needed, keys=KEYS, ts: str = TS) -> DataFrame:
    """Drop rows with a NULL, but no rows of a series for a column whose first value comes later than any frame reaches.

    A z-score of a value that never moved has none, for instance. A column without a value within the reach of the
    frames after the first row stays NULL where it is. Columns in ``needed`` must have a value. One aggregate over the
    staged rows decides.
    """
    needed = list(dict.fromkeys([*keys, ts, *needed]))
    optional = [c for c in df.columns if c not in needed]
    rows = stage(df.na.drop(subset=needed))
    hour = chunks.hour_index(ts)
    wait = lambda c: F.min(F.when(F.col(c).isNotNull(), hour)) - F.min(hour)
    filled = rows.groupBy(*keys).agg(F.array(*[F.coalesce(wait(c) <= HALO_ROWS, F.lit(False)) for c in optional]).alias("_filled"))
    rows = chunks.attach(rows, filled, keys, ts)
    return rows.where(all_of(F.col(c).isNotNull() | ~F.col("_filled")[i] for i, c in enumerate(optional))).drop("_filled")


def finalise(
    df: DataFrame, keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING, drop_empty_columns: bool = True
) -> DataFrame:
    """Infinities to NULL, unlimited forward fill of numeric columns, then drop rows with any NULL."""
    part = df if chunks.CHUNK in df.columns else chunks.core(chunks.split(df, ts, chunking=chunking), keep_chunk=True)
    out = chunks.carry(part, keys, ts, fills=_fill_values(part, keys)).drop(chunks.CHUNK)
    return (drop_all_null(out) if drop_empty_columns else out).na.drop()


def _fill_values(df: DataFrame, keys) -> dict:
    skip = (*keys, chunks.CHUNK, "cache_version", "weather_cache_version", "weather_cache_lat", "weather_cache_lon")
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return {c: finite(F.col(c)) if c in floating else F.col(c) for c in numeric_columns(df, exclude=skip)}


def build_features(
    df: DataFrame, keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING, shares: DataFrame | None = None,
    drop_empty_columns: bool = True, needed=None,
) -> DataFrame:
    """Optional context, all feature families, and the final fill and drop.

    The windowed frame feeds the chunk summaries and the rows themselves, so it is staged once.
    The volatility threshold and the final fill share one carry. With ``needed`` the drop is that of
    :func:`drop_incomplete`.
    """
    part = stage(windowed_features(fill_optional_context(df, keys, ts, shares), keys, ts, chunking))
    part = part.withColumn("_rv", F.struct("realized_volatility_24"))
    out = chunks.carry(part, keys, ts, fills=_fill_values(part, keys))
    out = out.withColumn("high_vol_regime", flag(F.col("_rv.realized_volatility_24") > F.col("_vol_q70")).cast("int"))
    out = out.drop("_rv", "_vol_q70", chunks.CHUNK)
    if needed is not None:
        return drop_incomplete(out, needed, keys, ts)
    return (drop_all_null(out) if drop_empty_columns else out).na.drop()


def shift_for_horizon(df: DataFrame, cols, horizon: int = 1, keys=KEYS, ts: str = TS, chunking=DEFAULT_CHUNKING):
    """Features known ``horizon`` rows before the target row (closes the same-hour leak)."""
    part = chunks.split(df, ts, back=horizon, chunking=chunking)
    w = ordered(chunks.chunk_keys(keys), ts)
    return chunks.core(part.withColumns({c: F.lag(c, horizon).over(w) for c in cols}))
