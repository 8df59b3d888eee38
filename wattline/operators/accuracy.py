"""Directional accuracy of decisions against the move over a horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT_CHUNKING, Chunking
from ..functions import chunks
from ..functions.columns import at_least, flag, zero
from ..functions.windows import ordered
from ..schema import KEYS, PRICE, TS


def future_price(w, horizon: int) -> Column:
    return F.lead(PRICE, horizon).over(w)


def add_accuracy(df: DataFrame, horizon: int = 1, tolerance: float = 0.002) -> DataFrame:
    """Accuracy columns for a frame that already has ``future_price_eur_mwh``."""
    if horizon < 1:
        raise ValueError("accuracy horizon must be at least 1 step")
    if tolerance < 0:
        raise ValueError("hold tolerance must be non-negative")
    change = F.col("future_price_eur_mwh") - F.col(PRICE)
    out = df.withColumns(
        {
            "future_price_change_eur_mwh": change,
            "future_price_return": zero(change / at_least(F.abs(PRICE), 1.0)),
            "pnl_positive": flag(F.col("pnl") > 0),
        }
    )
    move, known = F.col("future_price_change_eur_mwh"), F.col("future_price_eur_mwh").isNotNull()
    d = F.col("decision")
    right = (
        ((d == "LONG") & flag(move > 0))
        | ((d == "SHORT") & flag(move < 0))
        | ((d == "HOLD") & (F.abs("future_price_return") <= tolerance))
    )
    out = out.withColumn("directional_correct", flag(right & known))
    return out.withColumns(
        {
            "accuracy_status": F.when(~known, F.lit("pending"))
            .when(F.col("directional_correct"), F.lit("correct"))
            .otherwise(F.lit("incorrect")),
            "accuracy_horizon_steps": F.lit(horizon),
            "hold_tolerance_pct": F.lit(float(tolerance)),
        }
    )


def decision_accuracy(
    df: DataFrame, horizon: int = 1, tolerance: float = 0.002, keys=KEYS, ts: str = TS,
    chunking: Chunking = DEFAULT_CHUNKING,
) -> DataFrame:
    """Recompute the future price for ``horizon`` and judge each decision."""
    part = chunks.split(df, ts, ahead=horizon, chunking=chunking)
    w = ordered(chunks.chunk_keys(keys), ts)
    part = part.withColumn("future_price_eur_mwh", future_price(w, horizon))
    return add_accuracy(chunks.core(part), horizon, tolerance)


def accuracy_summary(df: DataFrame, keys=KEYS) -> DataFrame:
    known = F.col("accuracy_status") != "pending"
    share = lambda c: zero(F.avg(F.when(known, F.col(c).cast("double"))))
    return df.groupBy(*keys).agg(
        F.count_if(known).alias("evaluable_rows"),
        share("directional_correct").alias("directional_accuracy"),
        share("pnl_positive").alias("pnl_positive_rate"),
        F.count_if(F.col("accuracy_status") == "correct").alias("correct_count"),
        F.count_if(F.col("accuracy_status") == "incorrect").alias("incorrect_count"),
        F.count_if(~known).alias("pending_count"),
        *[F.count_if(F.col("decision") == d).alias(f"{d.lower()}_count") for d in ("LONG", "SHORT", "HOLD")],
    )
