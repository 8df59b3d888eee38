"""Column names and fixed schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

KEYS = ("series_id",)
TS = "timestamp_utc"
PRICE = "price_eur_mwh"
DAY_AHEAD = "day_ahead_price_eur_mwh"
INTRADAY = "intraday_price_eur_mwh"
SPREAD = "intraday_day_ahead_spread_eur_mwh"
IMBALANCE = "imbalance_price_eur_mwh"
IMBALANCE_BUY = "imbalance_price_buy_eur_mwh"
IMBALANCE_SELL = "imbalance_price_sell_eur_mwh"
DEMAND = "demand_kw"
RENEWABLE = "renewable_mw"
RENEWABLE_FORECAST = "intraday_renewable_forecast_mw"
PRED_PRICE = "pred_price_eur_mwh"
PRED_DEMAND = "pred_demand_kw"
PRED_RENEWABLE = "pred_renewable_mw"

QUALITY = "data_quality"
SOURCE = "data_source"
IS_SYNTHETIC = "is_synthetic"
FETCHED = "fetch_timestamp_utc"
VERSION = "cache_version"
ZONE = "zone"

# The column lists of the two raw datasets.
ENERGY_VALUES = (
    PRICE, DAY_AHEAD, INTRADAY, SPREAD, IMBALANCE,
    IMBALANCE_BUY, IMBALANCE_SELL, DEMAND, RENEWABLE, RENEWABLE_FORECAST,
)
ENERGY_REQUIRED = (PRICE, DAY_AHEAD, DEMAND, RENEWABLE)
WEATHER_VALUES = ("temperature_c", "wind_speed_mps", "radiation_wm2", "humidity_pct")
OPTIONAL_CONTEXT = (DAY_AHEAD, INTRADAY, IMBALANCE, RENEWABLE_FORECAST)
FEATURE_REQUIRED = (TS, PRICE, DEMAND, RENEWABLE, *WEATHER_VALUES)
SCORED_REQUIRED = (TS, PRED_DEMAND, PRED_RENEWABLE, PRED_PRICE, PRICE)
QUALITY_RANKS = {"synthetic": 0, "partially_synthetic": 1, "real": 2}
SCHEMA_VERSION = 1

PROVENANCE_FIELDS = (
    T.StructField(SOURCE, T.StringType()),
    T.StructField(IS_SYNTHETIC, T.BooleanType()),
    T.StructField(QUALITY, T.StringType()),
    T.StructField(FETCHED, T.TimestampType()),
    T.StructField(VERSION, T.IntegerType()),
)
PROVENANCE = tuple(f.name for f in PROVENANCE_FIELDS)


def _panel_schema(values, extra=()) -> T.StructType:
    fields = [T.StructField(KEYS[0], T.StringType()), T.StructField(TS, T.TimestampType())]
    fields += [T.StructField(v, T.DoubleType()) for v in values]
    fields += list(PROVENANCE_FIELDS) + [T.StructField(ZONE, T.StringType()), *extra]
    return T.StructType(fields)


ENERGY_SCHEMA = _panel_schema(ENERGY_VALUES)
WEATHER_SCHEMA = _panel_schema(
    WEATHER_VALUES,
    (T.StructField("weather_lat", T.DoubleType()), T.StructField("weather_lon", T.DoubleType())),
)
SCORED_SCHEMA = T.StructType(
    [T.StructField(KEYS[0], T.StringType()), T.StructField(TS, T.TimestampType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in (PRICE, DAY_AHEAD, INTRADAY, DEMAND, RENEWABLE, PRED_PRICE, PRED_DEMAND, PRED_RENEWABLE)
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the columns of ``schema``: missing ones as NULL, unreadable values as NULL."""
    have = set(df.columns)

    def one(field: T.StructField) -> Column:
        value = F.col(field.name) if field.name in have else F.lit(None)
        value = value.try_cast(field.dataType)
        if field.dataType == T.DoubleType():
            value = nan_to_null(value)
        elif field.name == IS_SYNTHETIC:
            value = F.coalesce(value, F.lit(False))
        elif field.name == VERSION:
            value = F.coalesce(value, F.lit(SCHEMA_VERSION))
        return value.alias(field.name)

    return df.select(*[one(f) for f in schema.fields])


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Fail before any job runs when a needed column is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
