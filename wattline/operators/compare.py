"""Strategy and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT_CHUNKING, BacktestConfig, Chunking, ForecastConfig
from ..functions.staging import stage
from ..schema import KEYS, TS
from . import significance
from .accuracy import add_accuracy
from .backtest import STRATEGY, execute, forecast_errors, metrics, prepare
from .baselines import BASELINES, TARGETS, with_baselines
from .signals import apply_signal

# strategy -> (forecast columns, uses the new signal branch)
STRATEGIES = {
    "original_strategy": (None, False),
    "upgraded_strategy": (None, True),
    "persistence": ("persistence", True),
    "seasonal": ("seasonal", True),
    "naive_mean_reversion": ("naive_mean_reversion", False),
    "zero_signal": ("zero_signal", True),
}
CANDIDATES = ("upgraded_strategy", "original_strategy")


def signal_mode(name: str) -> str:
    if name == "zero_signal":
        return "zero_signal"
    return {"original_strategy": "legacy", "upgraded_strategy": "model"}.get(name, "baseline")


def strategy_rows(
    scored: DataFrame, cfg: BacktestConfig = BacktestConfig(), keys=KEYS, ts: str = TS,
    chunking: Chunking = DEFAULT_CHUNKING, strategies=tuple(STRATEGIES), scale: DataFrame | None = None,
) -> DataFrame:
    """Backtest rows of several strategies, keyed by (series, strategy).

    Market windows are computed once per series; the frame is multiplied by strategy only after them.
    """
    market = prepare(with_baselines(scored, keys, ts, chunking), cfg, keys, ts, chunking, scale=scale)
    options = []
    for name in strategies:
        source, new = STRATEGIES[name]
        preds = [F.col(f"{source}__{p}" if source else p).alias(f"_p_{p}") for p in TARGETS]
        options.append(
            F.struct(
                F.lit(name).alias(STRATEGY),
                F.lit("" if source is None else name).alias("baseline_name"),
                F.lit(signal_mode(name)).alias("signal_mode"),
                F.lit(new).alias("_new"),
                *preds,
            )
        )
    unused = [f"{b}__{p}" for b in BASELINES for p in TARGETS]
    rows = market.withColumn("_option", F.explode(F.array(*options))).drop(*unused)
    rows = rows.select(*[c for c in rows.columns if c not in ("_option", *TARGETS)], "_option.*")
    rows = rows.withColumnsRenamed({f"_p_{p}": p for p in TARGETS})
    signals = apply_signal(rows, cfg.signal, F.col("_new"), F.col("signal_mode") == "zero_signal")
    out = execute(signals, cfg, [*keys, STRATEGY], ts, new_signal=F.col("_new")).drop("_new")
    return add_accuracy(out, cfg.horizon, cfg.hold_tolerance)


def compare_strategies(
    scored: DataFrame, cfg: BacktestConfig = BacktestConfig(), fc: ForecastConfig = ForecastConfig(), keys=KEYS,
    ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING, provenance: DataFrame | None = None, method: str = "iid",
) -> tuple[DataFrame, DataFrame]:
    """(metrics per series and strategy with Sharpe intervals and rank, significance against baselines)."""
    rows = stage(strategy_rows(scored, cfg, keys, ts, chunking))
    table = metrics(rows, cfg, [*keys, STRATEGY], ts)
    boot = significance.bootstrap(
        significance.wide_returns(rows, list(STRATEGIES), keys, ts), list(STRATEGIES), cfg.annualization,
        fc.bootstrap_iterations, fc.seed, keys, method,
    )
    boot = stage(boot)
    ci = significance.sharpe_intervals(boot, list(STRATEGIES), keys)
    table = table.join(ci, [*keys, STRATEGY])
    if provenance is None:
        table = table.withColumn("energy_source_research_grade", F.lit(False))
    else:
        grade = provenance.select(*keys, F.col("research_grade").alias("energy_source_research_grade"))
        table = table.join(grade, list(keys), "left")
    pairs = [(a, b) for a in CANDIDATES for b in BASELINES]
    return rank_strategies(table, keys), significance.paired(boot, pairs, keys)


def rank_strategies(table: DataFrame, keys=KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(
        F.col("sharpe_ratio").desc_nulls_last(),
        F.col("total_pnl").desc_nulls_last(),
        F.col("directional_accuracy").desc_nulls_last(),
        F.col(STRATEGY),
    )
    return table.withColumn("rank", F.row_number().over(w))


def rank_models(summary: DataFrame, keys=KEYS, name: str = "model_key") -> DataFrame:
    """Rank by Sharpe, P&L and accuracy (high first), then price MAE and name (low first); NULLs last."""
    for c in ("sharpe_ratio", "total_pnl", "directional_accuracy", "price_mae"):
        if c not in summary.columns:
            summary = summary.withColumn(c, F.lit(None).cast("double"))
    w = Window.partitionBy(*keys).orderBy(
        F.col("sharpe_ratio").desc_nulls_last(),
        F.col("total_pnl").desc_nulls_last(),
        F.col("directional_accuracy").desc_nulls_last(),
        F.col("price_mae").asc_nulls_last(),
        F.col(name).asc_nulls_last(),
    )
    return summary.withColumn("rank", F.row_number().over(w))


def compare_models(
    features: DataFrame, trainers: dict, cfg: BacktestConfig = BacktestConfig(), fc: ForecastConfig = ForecastConfig(),
    keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING, method: str = "iid",
) -> tuple[DataFrame | None, list[dict]]:
    """Train, score and backtest each model; rank them per series. A failing model is recorded and skipped.

    The loop is over the few models; the work of each is a Spark job over all series.
    """
    rows, failures = None, []
    for model_key, train in trainers.items():
        try:
            scored = stage(train(features, fc, keys, ts))
            table, sig = compare_strategies(scored, cfg, fc, keys, ts, chunking, method=method)
            errors = forecast_errors(scored, keys=keys).withColumnsRenamed(
                {"price_eur_mwh_mae": "price_mae", "price_eur_mwh_rmse": "price_rmse"}
            )
            beats = sig.where((F.col(STRATEGY) == "upgraded_strategy") & (F.col("baseline_name") == "persistence"))
            beats = beats.select(*keys, F.col("significant_outperformance").alias("significant_vs_persistence"))
            one = (
                table.where(F.col(STRATEGY) == "upgraded_strategy")
                .drop("rank")
                .join(errors, list(keys), "left")
                .join(beats, list(keys), "left")
                .withColumn("model_key", F.lit(model_key))
            )
            one = stage(one)
            rows = one if rows is None else rows.unionByName(one)
        except Exception as error:  # noqa: BLE001 - one model must not stop the comparison
            failures.append({"model_key": model_key, "error": str(error)})
    return (None if rows is None else rank_models(rows, keys)), failures


def winners(ranked: DataFrame, keys=KEYS) -> DataFrame:
    return ranked.where("rank = 1").select(
        *keys, F.col("model_key").alias("winner_model"), F.col("sharpe_ratio").alias("winner_sharpe_ratio")
    )
