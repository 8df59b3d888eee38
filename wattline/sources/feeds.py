"""Raw feeds with varying columns to the fixed market columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import row_mean, row_sum, utc
from ..schema import IMBALANCE, IMBALANCE_BUY, IMBALANCE_SELL, KEYS, TS


def value_columns(df: DataFrame, keys=KEYS, ts: str = TS) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (*keys, ts)]


def wide_feed_to_column(df: DataFrame, how: str, out: str, cols=None, keys=KEYS, ts: str = TS) -> DataFrame:
    """Collapse many source columns into one: a row sum (generation mix) or a row mean (sessions)."""
    cols = list(cols or value_columns(df, keys, ts))
    if not cols:
        return df.select(*keys, ts, F.lit(None).cast("double").alias(out))
    value = {"sum": row_sum, "mean": row_mean}[how](cols)
    return df.select(*keys, ts, value.alias(out))


def split_two_sided_price(df: DataFrame, long: str = "Long", short: str = "Short", keys=KEYS, ts: str = TS) -> DataFrame:
    """Buy and sell price from the named columns, else the first two numeric ones, else one for both."""
    cols = value_columns(df, keys, ts)
    if long in df.columns and short in df.columns:
        buy, sell = F.col(long).try_cast("double"), F.col(short).try_cast("double")
    elif len(cols) >= 2:
        buy, sell = F.col(cols[0]), F.col(cols[1])
    elif cols:
        buy = sell = F.col(cols[0])
    else:
        buy = sell = F.lit(None)
    out = df.select(*keys, ts, buy.cast("double").alias(IMBALANCE_BUY), sell.cast("double").alias(IMBALANCE_SELL))
    return out.withColumn(IMBALANCE, row_mean([IMBALANCE_BUY, IMBALANCE_SELL]))


def normalise_feed(df: DataFrame, column: str, ts_col: str, keys=KEYS, ts: str = TS, zone: str | None = None):
    """Name the only value column, flatten struct columns with a space, and make the time an instant."""
    cols = []
    for f in df.schema.fields:
        if f.name in (*keys, ts_col):
            continue
        if isinstance(f.dataType, T.StructType):
            cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name.strip()} {g.name.strip()}".strip()) for g in f.dataType]
        else:
            cols.append(F.col(f"`{f.name}`"))
    if len(cols) == 1:
        cols = [cols[0].alias(column)]
    return df.select(*keys, utc(F.col(ts_col), zone).alias(ts), *cols)


# Variable names of the hourly weather payload.
HOURLY_NAMES = {
    "time": TS,
    "temperature_2m": "temperature_c",
    "wind_speed_10m": "wind_speed_mps",
    "shortwave_radiation": "radiation_wm2",
    "relative_humidity_2m": "humidity_pct",
}
HOURLY_SCHEMA = T.StructType(
    [
        T.StructField(KEYS[0], T.StringType()),
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in list(HOURLY_NAMES)[1:]]
            ),
        ),
    ]
)


def explode_hourly(df: DataFrame, keys=KEYS, column: str = "hourly") -> DataFrame:
    """Parallel arrays of one payload to one row per hour."""
    arrays = [F.col(f"{column}.{n}").alias(n) for n in HOURLY_NAMES]
    rows = df.select(*keys, *arrays).select(*keys, F.inline(F.arrays_zip(*HOURLY_NAMES)))
    return rows.withColumnsRenamed(HOURLY_NAMES).withColumn(TS, F.col(TS).try_cast("timestamp"))
