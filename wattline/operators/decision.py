"""Rule-based decision from a small regression on each series' own history."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import DEFAULT_CHUNKING, Chunking
from ..functions import chunks
from ..functions.columns import at_least, clip, position_label
from ..functions.staging import stage
from ..functions.windows import ordered
from ..schema import KEYS, PRED_DEMAND, PRED_PRICE, PRED_RENEWABLE, PRICE, TS

MIN_ROWS = 5


def safe_zscore(x: Column, mean: Column, std: Column) -> Column:
    """Full-sample z-score; a missing or tiny deviation gives 0 for every row."""
    return F.when(std.isNull() | (std < 1e-6), F.lit(0.0)).otherwise((x - mean) / std)


def full_zscore(df: DataFrame, cols: dict[str, str], keys=KEYS, ts: str = TS) -> DataFrame:
    """Adds z-scores over the whole series: ``cols`` maps input to output name."""
    chunked = chunks.CHUNK in df.columns
    df = stage(df if chunked else chunks.split(df, ts, keys=keys).drop(chunks.HALO))
    stats = df.groupBy(*keys).agg(
        *[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]
    )
    out = chunks.attach(df, stats, keys, ts)
    out = out.withColumns({o: safe_zscore(F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c, o in cols.items()})
    return out.drop(*[f"_{x}_{c}" for c in cols for x in ("m", "s")], *([] if chunked else [chunks.CHUNK]))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve3(gram: pd.Series) -> pd.Series:
    """Minimum-norm least squares from [n, z, d, zz, zd, dd, y, zy, dy] sums, one row per series."""
    g = np.array(gram.tolist(), dtype=float)
    n, z, d, zz, zd, dd, y, zy, dy = g.T
    a = np.stack([np.stack([n, z, d], -1), np.stack([z, zz, zd], -1), np.stack([d, zd, dd], -1)], 1)
    w = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ np.stack([y, zy, dy], -1)[..., None]
    return pd.Series(list(w[..., 0]))


def fallback_decision(
    df: DataFrame, keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """Regress the next return on two z-scores per series, score the latest row, size by a sigmoid."""
    part = chunks.split(df, ts, ahead=1, chunking=chunking)
    p, nxt = F.col(PRICE), F.lead(PRICE).over(ordered(chunks.chunk_keys(keys), ts))
    rows = chunks.core(part.withColumn("_y", (nxt - p) / at_least(F.abs(p), 1.0)), keep_chunk=True).select(
        *keys,
        chunks.CHUNK,
        ts,
        "_y",
        (F.col(PRED_DEMAND) / 1000.0 - F.col(PRED_RENEWABLE)).alias("_imb"),
        (F.col(PRED_PRICE) - p).alias("_chg"),
    )
    rows = full_zscore(rows, {"_imb": "_z", "_chg": "_d"}, keys, ts)
    z, d, y = F.col("_z"), F.col("_d"), F.col("_y")
    use = z.isNotNull() & d.isNotNull() & y.isNotNull()
    total = lambda x: F.coalesce(F.sum(F.when(use, x)), F.lit(0.0))
    agg = rows.groupBy(*keys).agg(
        F.count_if(use).alias("train_rows"),
        F.array(
            total(F.lit(1.0)), total(z), total(d), total(z * z), total(z * d), total(d * d), total(y), total(z * y),
            total(d * y),
        ).alias("_gram"),
        F.max_by(F.struct("_z", "_d"), ts).alias("_last"),
    )
    w = F.when(F.col("train_rows") >= MIN_ROWS, F.col("_w")).otherwise(F.array(*[F.lit(0.0)] * 3))
    out = agg.withColumn("_w", solve3("_gram")).withColumn("_w", w)
    score = F.col("_w")[0] + F.col("_w")[1] * F.col("_last._z") + F.col("_w")[2] * F.col("_last._d")
    out = out.withColumn("score", score)
    out = out.withColumn("prob_up", F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(F.col("score"), -35.0, 35.0))))
    position = clip((F.col("prob_up") - 0.5) * 2.0, -1.0, 1.0)
    return out.select(
        *keys,
        "train_rows",
        position_label(position).alias("decision"),
        position.alias("position"),
        "prob_up",
        F.round(F.abs(position), 3).alias("confidence"),
        "score",
        F.col("_w")[0].alias("weight_intercept"),
        F.col("_w")[1].alias("weight_imbalance"),
        F.col("_w")[2].alias("weight_price_change"),
    )
