"""Forecast error breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT_CHUNKING, Chunking
from ..functions import chunks
from ..functions.columns import flag
from ..functions.order_stats import quantile
from ..functions.staging import stage
from ..functions.windows import ordered, rolling_std
from ..schema import KEYS, PRED_PRICE, PRICE, TS


def _error():
    return F.col(PRED_PRICE) - F.col(PRICE)


def _by_regime(rows: DataFrame, regime: str, keys, ts: str, mean: str, median: str, deviation: str | None) -> DataFrame:
    """Mean, median and count of column ``_e`` per series and regime; ``rows`` are staged and chunked."""
    by = [*keys, regime]
    spread = [F.stddev_samp("_e").alias(deviation)] if deviation else []
    sums = rows.groupBy(*by).agg(F.avg("_e").alias(mean), *spread, F.count("_e").alias("n"))
    return sums.join(quantile(rows, by, ts, F.col("_e"), 0.5, median), by, "left")


def error_by_price_regime(scored: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """Signed error above and below the median price of the series."""
    part = stage(chunks.split(scored.select(*keys, ts, PRICE, PRED_PRICE), ts, keys=keys).drop(chunks.HALO))
    mid = quantile(part, keys, ts, F.col(PRICE), 0.5, "_mid")
    regime = F.when(flag(F.col(PRICE) >= F.col("_mid")), F.lit("high_price")).otherwise(F.lit("low_price"))
    rows = chunks.attach(part, mid, keys, ts).withColumns({"_e": _error(), "price_regime": regime})
    return _by_regime(stage(rows), "price_regime", keys, ts, "mean_error", "median_error", "std_error")


def error_by_hour(scored: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    e = F.abs(_error())
    return scored.groupBy(*keys, F.hour(ts).alias("hour")).agg(
        F.avg(e).alias("mean_abs_error"), F.max(e).alias("max_abs_error"), F.count(e).alias("n")
    )


def error_by_vol_regime(
    scored: DataFrame, keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """Absolute error in calm and volatile rows, split at the 70% quantile of the series' volatility."""
    part = chunks.split(scored.select(*keys, ts, PRICE, PRED_PRICE), ts, back=25, chunking=chunking)
    w = ordered(chunks.chunk_keys(keys), ts)
    part = part.withColumn("_step", F.col(PRICE) - F.lag(PRICE).over(w))
    part = part.withColumn("_vol", rolling_std(F.col("_step"), w, 24, 6))
    part = chunks.core(part, keep_chunk=True)
    part = stage(chunks.carry(part, keys, ts, fills={"_vol": F.col("_vol")}))
    cut = quantile(part, keys, ts, F.col("_vol"), 0.7, "_cut")
    high = flag(F.col("_vol") > F.coalesce("_cut", F.lit(0.0)))
    regime = F.when(high, F.lit("high_vol")).otherwise(F.lit("low_vol"))
    rows = chunks.attach(part, cut, keys, ts).withColumns({"_e": F.abs(_error()), "vol_regime": regime})
    return _by_regime(stage(rows), "vol_regime", keys, ts, "mean_abs_error", "median_abs_error", None)
