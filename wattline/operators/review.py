"""Review and reporting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT_CHUNKING, Chunking
from ..functions import chunks
from ..functions.columns import flag, position_label
from ..functions.windows import ordered, rolling_mean
from ..schema import (
    DEMAND, KEYS, PRED_DEMAND, PRED_PRICE, PRED_RENEWABLE, PRICE, RENEWABLE, TS,
)
from .accuracy import accuracy_summary, decision_accuracy
from .backtest import STRATEGY

LOG_COLUMNS = (
    TS, "decision", PRED_PRICE, PRICE, "future_price_change_eur_mwh", "future_price_return", "directional_correct",
    "accuracy_status", "pnl", "pnl_positive",
)


def filter_dates(df: DataFrame, start: str, end: str, ts: str = TS) -> DataFrame:
    """Rows from the start of ``start`` to the end of ``end``; a date-only end covers its whole day.

    Plain comparisons with constants, so they reach the file scan.
    """
    lo = F.lit(start).cast("timestamp")
    if len(end) <= 10:
        return df.where((F.col(ts) >= lo) & (F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))
    return df.where((F.col(ts) >= lo) & (F.col(ts) <= F.lit(end).cast("timestamp")))


def last_n(df: DataFrame, n: int, keys=KEYS, ts: str = TS) -> DataFrame:
    """Last n rows per series; Spark cuts each task to n rows per series before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_row(df: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ts).alias("_row")).select(*keys, "_row.*")


def top_by_size(df: DataFrame, value: str, n: int = 20, absolute: bool = True, tie: str | None = None) -> DataFrame:
    key = F.abs(value) if absolute else F.col(value)
    return df.orderBy(key.desc_nulls_last(), *([F.col(tie)] if tie else [])).limit(n)


def review_dataset(result: DataFrame, horizon: int, tolerance: float, keys=KEYS, ts: str = TS):
    """(rows judged at a new horizon, summary per series)."""
    rows = decision_accuracy(result, horizon, tolerance, keys, ts)
    return rows, accuracy_summary(rows, keys)


def rolling_accuracy(
    review: DataFrame, size: int = 12, keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    part = chunks.split(review, ts, back=size, chunking=chunking)
    w = ordered(chunks.chunk_keys(keys), ts)
    part = part.withColumns(
        {
            "rolling_directional_accuracy": rolling_mean(F.col("directional_correct").cast("double"), w, size, 1),
            "rolling_pnl_positive_rate": rolling_mean(F.col("pnl_positive").cast("double"), w, size, 1),
        }
    )
    return chunks.core(part)


def decision_log(review: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """Review columns, newest first."""
    cols = [c for c in LOG_COLUMNS if c in review.columns and c != ts]
    return review.select(*keys, ts, *cols).orderBy(F.col(ts).desc(), *keys)


def market_snapshot(result: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """The latest row per series as a decision surface sees it."""
    row = latest_row(result, keys, ts)
    change = F.col(PRED_PRICE) - F.col(PRICE)
    return row.select(
        *keys,
        ts,
        F.col("recommended_decision").alias("recommended_action"),
        PRED_PRICE,
        PRICE,
        change.alias("expected_price_change_eur_mwh"),
        F.when(F.col(PRICE) == 0, F.lit(0.0)).otherwise(F.try_divide(change, F.col(PRICE))).alias(
            "expected_price_change_pct"
        ),
        (F.col(PRED_DEMAND) / 1000.0 - F.col(PRED_RENEWABLE)).alias("pred_imbalance_mw"),
        "position",
        position_label(F.col("position")).alias("position_label"),
        "price_trend",
        "rolling_volatility",
        "signal_z_score",
    )


def chart_series(df: DataFrame, n: int = 300, keys=KEYS, ts: str = TS) -> DataFrame:
    return last_n(df, n, keys, ts).select(*keys, ts, PRICE, (F.col(DEMAND) / 1000.0).alias("demand_mw"), RENEWABLE)


def decision_events(
    scored: DataFrame, n: int = 24, model_key: str = "model", keys=KEYS, ts: str = TS, logged_at=None
) -> DataFrame:
    """Last n rows per series as log events."""
    rows = last_n(scored, n, keys, ts)
    zero = F.lit(0.0)
    position = F.col("position") if "position" in rows.columns else zero
    target = F.col("target_position") if "target_position" in rows.columns else zero
    return rows.select(
        *keys,
        (F.current_timestamp() if logged_at is None else logged_at).alias("logged_at_utc"),
        ts,
        PRED_DEMAND,
        PRED_RENEWABLE,
        (F.col(PRED_DEMAND) / 1000.0 - F.col(PRED_RENEWABLE)).alias("pred_imbalance_mw"),
        PRED_PRICE,
        target.alias("target_position"),
        position.alias("executed_position"),
        position_label(position).alias("decision"),
        F.lit(model_key).alias("model_key"),
    )


def research_summary(significance: DataFrame, provenance: DataFrame, keys=KEYS) -> DataFrame:
    """Facts of a research note per series, as codes and numbers: edge, coverage, baselines not beaten, grade.

    The list holds at most one name per baseline.
    """
    facts = significance.groupBy(*keys).agg(
        F.array_sort(
            F.collect_set(
                F.when(
                    (F.col(STRATEGY) == "upgraded_strategy") & ~flag(F.col("significant_outperformance")),
                    F.col("baseline_name"),
                )
            )
        ).alias("_weak"),
    )
    return provenance.join(facts, list(keys), "left").select(
        *keys,
        F.when(F.col("_weak").isNull(), F.lit("untested")).when(F.size("_weak") == 0, F.lit("beats_all")).otherwise(F.lit("beaten"))
        .alias("edge"),
        F.round(F.col("synthetic_coverage_ratio") * 100, 1).alias("synthetic_percent"),
        F.round(F.col("partial_synthetic_coverage_ratio") * 100, 1).alias("partial_synthetic_percent"),
        F.concat_ws(",", "_weak").alias("not_beaten"),
        F.col("research_grade"),
    )
