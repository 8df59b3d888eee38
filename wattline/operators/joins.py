"""Joins of feeds, panels and fold tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import chunks
from ..schema import DAY_AHEAD, DEMAND, INTRADAY, KEYS, PRICE, SPREAD, TS

# Names of weather provenance after a join with energy rows.
WEATHER_RENAMES = {
    "data_source": "weather_data_source",
    "is_synthetic": "weather_is_synthetic",
    "data_quality": "weather_data_quality",
    "fetch_timestamp_utc": "weather_fetch_timestamp_utc",
    "cache_version": "weather_cache_version",
    "zone": "weather_zone",
    "weather_lat": "weather_cache_lat",
    "weather_lon": "weather_cache_lon",
}


def join_feeds(feeds, keys=KEYS, ts: str = TS) -> DataFrame:
    """Full outer join of the main feeds on (series, time)."""
    return reduce(lambda a, b: a.join(b, [*keys, ts], "full_outer"), feeds)


def join_optional(base: DataFrame, feeds, keys=KEYS, ts: str = TS) -> DataFrame:
    """Left join of feeds that may lack hours."""
    return reduce(lambda a, b: a.join(b, [*keys, ts], "left"), feeds, base)


def derive_market_columns(df: DataFrame, demand_mw: str = "demand_mw") -> DataFrame:
    """Demand in kW, price from intraday else day-ahead, and their spread."""
    return df.withColumns(
        {
            DEMAND: F.col(demand_mw) * 1000.0,
            PRICE: F.coalesce(INTRADAY, DAY_AHEAD),
            SPREAD: F.col(INTRADAY) - F.col(DAY_AHEAD),
        }
    ).drop(demand_mw)


def join_energy_weather(energy: DataFrame, weather: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """Inner join on (series, time); weather provenance gets its own names."""
    return energy.join(weather.withColumnsRenamed(WEATHER_RENAMES), [*keys, ts], "inner")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def reindex_like(fallback: DataFrame, df: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """The fallback values at exactly the rows of ``df``."""
    return df.select(*keys, ts).join(fallback, [*keys, ts], "left")


def filter_isin(df: DataFrame, times: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    return df.join(times.select(*keys, ts), [*keys, ts], "left_semi")


def assign_folds(df: DataFrame, folds: DataFrame, keys=KEYS, ts: str = TS, index: str = chunks.ROW) -> DataFrame:
    """Each row with every fold it belongs to and its role (train or test).

    Folds step by their test length, so a row's fold numbers follow from its offset: the join is an
    equi-join on (series, fold), not a range comparison of all pairs.
    """
    steps = folds.groupBy(*keys).agg(
        F.min("test_start").alias("_first"),
        F.min(F.col("test_end") - F.col("test_start")).alias("_test"),
        F.min(F.col("train_end") - F.col("train_start")).alias("_train"),
        F.max("fold").alias("_last"),
    )
    i = F.col(index)
    lo = F.greatest(F.floor((i - F.col("_first")) / F.col("_test")), F.lit(0))
    hi = F.least(F.floor((i - F.col("_first") + F.col("_train")) / F.col("_test")), F.col("_last"))
    spread = (
        chunks.attach(df, steps, keys, ts, "inner")
        .where(hi >= lo)
        .withColumn("fold", F.explode(F.sequence(lo, hi)))
        .drop("_first", "_test", "_train", "_last")
    )
    joined = spread.join(folds, [*keys, "fold"])
    role = F.when((i >= F.col("train_start")) & (i < F.col("train_end")), F.lit("train")).when(
        (i >= F.col("test_start")) & (i < F.col("test_end")), F.lit("test")
    )
    return (
        joined.withColumn("role", role)
        .where(F.col("role").isNotNull())
        .drop("train_start", "train_end", "test_start", "test_end")
    )


def pair_streams(a: DataFrame, b: DataFrame, keys=KEYS, ts: str = TS, value: str = "strategy_return") -> DataFrame:
    """Pair two return streams by position within the series; the longer one is cut."""
    left = chunks.number_rows(a.select(*keys, ts, F.col(value).alias("a")), keys, ts)
    right = chunks.number_rows(b.select(*keys, ts, F.col(value).alias("b")), keys, ts).drop(ts)
    return left.join(right, [*keys, chunks.ROW])
