"""Frames the catalog queries start from, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import ForecastConfig
from ..functions import chunks
from ..functions.windows import ordered
from ..operators import gaps
from ..operators.joins import join_energy_weather
from ..schema import (
    DAY_AHEAD, DEMAND, FETCHED, IMBALANCE, IS_SYNTHETIC, PRED_DEMAND, PRED_PRICE, PRED_RENEWABLE, PRICE, QUALITY,
    RENEWABLE, SOURCE, TS, VERSION, WEATHER_VALUES, KEYS,
)
from .session import prepare

PANEL_VALUES = (PRICE, DEMAND, RENEWABLE, DAY_AHEAD, IMBALANCE)
TIE = 3e-9
KINDS = {PRICE: "purchase", DEMAND: "view", RENEWABLE: "click", DAY_AHEAD: "signup", IMBALANCE: "error"}
FOLDS = ForecastConfig(train_days=14, test_days=7)


def six(x):
    """Six decimals; a mean of decimal data that lies on a tie goes up whatever the order of its sum."""
    return F.round(x + F.lit(TIE / 10), 6)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str, per_user: bool = False) -> DataFrame:
    """Raw feed: a series per user, or users spread over four series."""
    who = F.col("user_id") if per_user else F.col("user_id") % 4
    return table(spark, sf, "events").withColumns(
        {"series_id": F.concat(F.lit("U" if per_user else "Z"), who.cast("string")), "ts": F.col("ts").cast("timestamp")}
    )


def panel(spark: SparkSession, sf: str, per_user: bool = False) -> DataFrame:
    """Hourly means per event type, one grouped pass over the events."""
    rows = events(spark, sf, per_user).withColumn(TS, F.date_trunc("hour", "ts"))
    mean = lambda kind: six(F.avg(F.when(F.col("event_type") == kind, F.col("value"))))
    out = rows.groupBy(*KEYS, TS).agg(*[mean(k).alias(c) for c, k in KINDS.items()])
    return out.withColumn(DEMAND, F.col(DEMAND) * 1000.0)


def aligned(spark: SparkSession, sf: str, per_user: bool = False) -> DataFrame:
    rows = panel(spark, sf, per_user)
    return gaps.align_to_grid(gaps.hourly_grid(gaps.series_bounds(rows)), rows)


def clean(spark: SparkSession, sf: str, per_user: bool = False) -> DataFrame:
    """Complete hourly panel with repaired gaps and resolved prices."""
    filled = gaps.interpolate_and_fill(aligned(spark, sf, per_user), list(PANEL_VALUES))
    rounded = filled.withColumns({c: six(F.col(c)) for c in PANEL_VALUES})
    return gaps.resolve_prices(rounded.withColumn("intraday_price_eur_mwh", F.lit(None).cast("double")))


def weather(spark: SparkSession, sf: str, per_user: bool = False) -> DataFrame:
    """Hourly statistics of the JSON counter as a weather-like panel, gaps repaired."""
    rows = events(spark, sf, per_user).withColumn(TS, F.date_trunc("hour", "ts"))
    k = F.get_json_object("props", "$.k").cast("double")
    hourly = rows.groupBy(*KEYS, TS).agg(
        six(F.avg(k)).alias(WEATHER_VALUES[0]),
        F.min(k).alias(WEATHER_VALUES[1]),
        F.max(k).alias(WEATHER_VALUES[2]),
        six(F.avg(k * k)).alias(WEATHER_VALUES[3]),
    )
    grid = gaps.hourly_grid(gaps.series_bounds(hourly))
    filled = gaps.interpolate_and_fill(gaps.align_to_grid(grid, hourly), list(WEATHER_VALUES))
    return filled.withColumns({c: six(F.col(c)) for c in WEATHER_VALUES})


def merged(spark: SparkSession, sf: str, per_user: bool = False) -> DataFrame:
    return join_energy_weather(
        clean(spark, sf, per_user).drop("had_gap"), weather(spark, sf, per_user).drop("had_gap")
    )


def with_simple_forecast(df: DataFrame) -> DataFrame:
    """Forecast columns that need no model: a 24-row mean and the previous values."""
    part = chunks.split(df, TS, back=24)
    w = ordered(chunks.chunk_keys(KEYS), TS)
    return chunks.core(
        part.withColumns(
            {
                PRED_PRICE: six(F.avg(PRICE).over(w.rowsBetween(-24, -1))),
                PRED_DEMAND: F.lag(DEMAND).over(w),
                PRED_RENEWABLE: F.lag(RENEWABLE).over(w),
            }
        )
    )


def scored(spark: SparkSession, sf: str, per_user: bool = False) -> DataFrame:
    return with_simple_forecast(clean(spark, sf, per_user).drop("had_gap"))


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means of line items per return flag: longer series without a model of their own."""
    rows = table(spark, sf, "lineitem").withColumns(
        {"series_id": F.col("l_returnflag"), TS: F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))}
    )
    return rows.groupBy(*KEYS, TS).agg(
        six(F.avg("l_extendedprice")).alias(PRICE), six(F.avg("l_quantity")).alias(DEMAND)
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a candidate row for its hour, with a quality and a fetch time: real conflicts."""
    e = F.col("event_id")
    q = F.when(e % 3 == 0, F.lit("real")).when(e % 3 == 1, F.lit("partially_synthetic")).otherwise(F.lit("synthetic"))
    fetched = F.when(e % 7 != 0, F.timestamp_seconds(F.lit(1706745600) + e % 1000))
    return events(spark, sf).select(
        *KEYS,
        F.date_trunc("hour", "ts").alias(TS),
        F.col("value").alias(PRICE),
        q.alias(QUALITY),
        F.lit("feed").alias(SOURCE),
        (q != "real").alias(IS_SYNTHETIC),
        fetched.alias(FETCHED),
        F.lit(1).alias(VERSION),
        e.alias("event_id"),
    )


def present(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Output form: times as text, doubles rounded half up within 3e-9 of a tie, no negative zero.

    The tolerance keeps means of decimal data, which often lie exactly on a tie, independent of the
    order in which an engine adds numbers.
    """

    def one(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            r = F.round(c + F.lit(TIE), special.get(f.name, digits))
            return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("long").alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema.fields])
