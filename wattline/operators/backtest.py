"""Cost-aware backtest of one or several strategies per series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT_CHUNKING, BacktestConfig, Chunking
from ..functions import chunks
from ..functions.columns import at_least, clip, decision_label, flag, position_label, zero
from ..functions.order_stats import quantile
from ..functions.staging import stage
from ..schema import INTRADAY, KEYS, PRED_PRICE, PRICE, SCORED_REQUIRED, TS, require_columns
from . import folds
from .accuracy import add_accuracy, future_price
from .signals import apply_signal, market_state

STRATEGY = "strategy_name"
COSTS = ("transaction_cost_eur", "spread_cost_eur", "slippage_cost_eur", "delay_cost_eur")
POSITION_TOLERANCE = 1e-6


def price_scale(df: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """Reference price of a series: the median of non-zero absolute prices, at least 1; no row where there is none."""
    size = F.abs(PRICE)
    median = quantile(df, keys, ts, F.when(size > 0, size), 0.5, "_median")
    return median.select(*keys, F.greatest("_median", F.lit(1.0)).alias("reference_price_eur_mwh"))


def prepare(
    scored: DataFrame, cfg: BacktestConfig = BacktestConfig(), keys=KEYS, ts: str = TS,
    chunking: Chunking = DEFAULT_CHUNKING, extra=None, scale: DataFrame | None = None,
) -> DataFrame:
    """Market state plus everything a backtest needs from windows over the market, staged once."""
    require_columns(scored, SCORED_REQUIRED)
    reach = max(1, cfg.horizon)

    def windows(w):
        p = F.col(PRICE)
        made = {
            "price_change_eur_mwh": zero(p - F.lag(p).over(w)),
            "forward_price_change_eur_mwh": zero(F.lead(p).over(w) - p),
            "future_price_eur_mwh": future_price(w, cfg.horizon),
        }
        return {**made, **(extra(w) if extra else {})}

    state = market_state(scored, cfg.signal, keys, ts, chunking, ahead=reach, extra=windows, keep_chunk=True)
    scale = price_scale(scored, keys, ts) if scale is None else scale
    priced = chunks.attach(state, scale, keys, ts)
    return stage(priced.withColumn("reference_price_eur_mwh", F.coalesce("reference_price_eur_mwh", F.lit(1.0))))


def execute(
    signals: DataFrame, cfg: BacktestConfig = BacktestConfig(), keys=KEYS, ts: str = TS,
    new_signal: Column | None = None,
) -> DataFrame:
    """Positions, fills, costs, P&L, equity and decisions for a chunked signal frame."""
    limit = abs(cfg.signal.position_limit)
    k = chunks.chunk_keys(keys)
    ramp = stage(folds.position_ramp(signals, cfg.max_position_change, limit, keys, ts))
    asked = zero(F.col("target_position"))
    capped = zero(clip(F.col("target_position"), -limit, limit))
    df = signals.withColumns({"target_position_capped": capped, "position_clipped": capped != asked}).join(
        ramp, [*k, ts]
    )
    exposure = F.lit(cfg.notional) / F.col("reference_price_eur_mwh")
    if cfg.execution_delay:
        position, change = F.col("_before"), F.col("_before") - F.col("_before2")
    else:
        position = F.col("target_position_constrained")
        change = position - F.col("_before")
    ref = F.coalesce(INTRADAY, PRICE)
    vol = zero(F.col("rolling_volatility"))
    df = df.withColumns(
        {
            "exposure_mwh": exposure,
            "execution_reference_price_eur_mwh": ref,
            "spread_eur_mwh": at_least(F.abs(ref), 1.0) * (cfg.spread_bps / 10000.0) + F.lit(cfg.spread_fixed),
            "price_return": F.col("price_change_eur_mwh") / F.col("reference_price_eur_mwh"),
            "position": position,
            "position_change": change,
            "turnover": F.abs(change),
        }
    ).drop("_before", "_before2")
    turn, size, spread = F.col("turnover"), F.col("exposure_mwh"), F.col("spread_eur_mwh")
    forward = F.col("forward_price_change_eur_mwh")
    df = df.withColumns(
        {
            "fill_price_eur_mwh": F.col("execution_reference_price_eur_mwh") + F.signum("position_change") * spread / 2.0,
            "spread_cost_eur": turn * size * (spread / 2.0),
            "slippage_eur_mwh": cfg.slippage_volatility * vol
            + cfg.slippage_turnover * turn * at_least(F.abs("execution_reference_price_eur_mwh"), 1.0),
            "delay_cost_eur": turn * size * vol * cfg.delay_penalty if cfg.execution_delay else F.lit(0.0),
            "transaction_cost_eur": turn * cfg.notional * (cfg.transaction_cost_bps / 10000.0),
            "gross_pnl_eur": F.col("position") * forward * size,
            "unfilled_position_change": F.abs(F.col("target_position_capped") - F.col("target_position_constrained")),
        }
    )
    df = df.withColumn("slippage_cost_eur", turn * size * F.col("slippage_eur_mwh"))
    df = df.withColumns(
        {
            "net_pnl_eur": F.col("gross_pnl_eur")
            - F.col("transaction_cost_eur")
            - F.col("spread_cost_eur")
            - F.col("slippage_cost_eur")
            - F.col("delay_cost_eur"),
            "opportunity_cost_proxy_eur": F.col("unfilled_position_change") * size * F.abs(forward),
        }
    )
    df = folds.equity_curve(df, "net_pnl_eur", cfg.notional, keys, ts)
    start = max(cfg.notional, 1.0)
    new = F.lit(cfg.signal.new_signal) if new_signal is None else new_signal
    decision = F.when(new, position_label(F.col("position"), POSITION_TOLERANCE)).otherwise(
        decision_label(F.col("position"), cfg.long_threshold, cfg.short_threshold)
    )
    return df.withColumns(
        {
            "equity_curve": F.col("equity_eur") / start,
            "cumulative_returns": F.col("equity_eur") / start - 1.0,
            "decision": decision,
        }
    )


def backtest(
    scored: DataFrame, cfg: BacktestConfig = BacktestConfig(), keys=KEYS, ts: str = TS,
    chunking: Chunking = DEFAULT_CHUNKING, zero_signal: bool = False, keep_chunk: bool = False,
) -> DataFrame:
    """Row-level result of one strategy per series."""
    signals = apply_signal(prepare(scored, cfg, keys, ts, chunking), cfg.signal, zero_signal=F.lit(zero_signal))
    out = execute(signals, cfg, keys, ts)
    out = add_accuracy(out, cfg.horizon, cfg.hold_tolerance)
    return out if keep_chunk else out.drop(chunks.CHUNK)


def sharpe(ret: Column, annualization: int) -> Column:
    """Annualised mean over deviation; no or zero deviation gives 0."""
    std = F.stddev_samp(ret)
    return F.coalesce(F.try_divide(F.avg(ret), std) * math.sqrt(annualization), F.lit(0.0))


def drawdowns(result: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """Largest drawdown and the longest run of rows below the running peak, per series.

    Under-water runs are found inside chunks and joined where one run fills the end of a chunk and
    goes on in the next.
    """
    rows = result if chunks.CHUNK in result.columns else chunks.core(chunks.split(result, ts), keep_chunk=True)
    k = chunks.chunk_keys(keys)
    equity = F.greatest(F.coalesce("equity_curve", F.lit(1.0)), F.lit(folds.EQUITY_FLOOR))
    rows = chunks.carry(rows.select(*k, ts, equity.alias("_e")), keys, ts, maxes={"_peak": F.col("_e")})
    w = Window.partitionBy(*k).orderBy(ts)
    rows = rows.withColumns(
        {
            "_dd": (F.col("_e") - F.col("_peak")) / F.col("_peak"),
            "_under": F.col("_e") < F.col("_peak"),
            "_run": F.sum((F.col("_e") >= F.col("_peak")).cast("int")).over(
                w.rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    )
    runs = rows.groupBy(*k, "_run").agg(
        F.count_if("_under").alias("_len"), F.min("_dd").alias("_dd"), F.count(F.lit(1)).alias("_rows")
    )
    per_chunk = runs.groupBy(*k).agg(
        F.max("_len").alias("_longest"),
        F.min("_dd").alias("_dd"),
        F.coalesce(F.max(F.when(F.col("_run") == 0, F.col("_len"))), F.lit(0)).alias("_lead"),
        F.max_by("_len", "_run").alias("_tail"),
        (F.max("_run") == 0).alias("_all"),
    )
    order = Window.partitionBy(*keys).orderBy(chunks.CHUNK)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    # Length under water when a chunk begins: the tail of the last chunk with a peak, plus the
    # chunks after it that lie under water as a whole.
    chained = per_chunk.withColumn("_seen", F.sum(F.when(~F.col("_all"), 1).otherwise(0)).over(upto))
    chained = chained.withColumn("_group", F.coalesce("_seen", F.lit(0)))
    inside = Window.partitionBy(*keys, "_group").orderBy(chunks.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    chained = chained.withColumns(
        {
            "_fill": F.coalesce(F.sum(F.when(F.col("_all"), F.col("_lead"))).over(inside), F.lit(0)),
            "_last_tail": F.coalesce(
                F.last(F.when(~F.col("_all"), F.col("_tail")), ignorenulls=True).over(upto), F.lit(0)
            ),
        }
    )
    crossing = F.when(F.col("_lead") > 0, F.col("_last_tail") + F.col("_fill") + F.col("_lead")).otherwise(0)
    return chained.groupBy(*keys).agg(
        F.min("_dd").alias("max_drawdown"),
        F.max(F.greatest(F.col("_longest"), crossing)).cast("long").alias("drawdown_duration_steps"),
    )


def metrics(result: DataFrame, cfg: BacktestConfig = BacktestConfig(), keys=KEYS, ts: str = TS) -> DataFrame:
    """The metrics row of each series (and strategy, when it is one of the keys)."""
    ret = F.col("strategy_return")
    known = F.col("future_price_eur_mwh").isNotNull()
    traded = F.col("decision").isin("LONG", "SHORT")
    share = lambda cond: zero(F.avg(F.when(known, cond.cast("double"))))
    total = lambda c: F.sum(c).alias(c)
    table = result.groupBy(*keys).agg(
        sharpe(ret, cfg.annualization).alias("sharpe_ratio"),
        (F.count_if(ret > 0) / F.greatest(F.count_if(ret != 0), F.lit(1))).alias("hit_rate"),
        F.sum("pnl").alias("total_pnl"),
        F.count_if(F.abs("position_change") > POSITION_TOLERANCE).alias("trade_count"),
        zero(F.avg(F.when(traded, ret))).alias("average_trade_return"),
        share(F.col("directional_correct")).alias("directional_accuracy"),
        share(F.col("pnl_positive")).alias("pnl_positive_rate"),
        *[total(c) for c in ("gross_pnl_eur", "net_pnl_eur", "spread_cost_eur", "slippage_cost_eur", "delay_cost_eur",
                             "opportunity_cost_proxy_eur")],
    )
    return table.join(drawdowns(result, keys, ts), list(keys))


def trade_count(df: DataFrame, position: str = "position", keys=KEYS, ts: str = TS) -> DataFrame:
    """Rebalances of a position column: labels count LONG / SHORT, numbers count changes."""
    if dict(df.dtypes)[position] == "string":
        return df.groupBy(*keys).agg(F.count_if(F.col(position).isin("LONG", "SHORT")).alias("trade_count"))
    part = chunks.split(df, ts, back=1)
    w = Window.partitionBy(*chunks.chunk_keys(keys)).orderBy(ts)
    x = zero(F.col(position))
    part = part.withColumn("_move", F.abs(F.coalesce(x - F.lag(x).over(w), x)))
    return chunks.core(part).groupBy(*keys).agg(F.count_if(F.col("_move") > POSITION_TOLERANCE).alias("trade_count"))


def price_moves(df: DataFrame, keys=KEYS, ts: str = TS, floor: float = 1.0, chunking=DEFAULT_CHUNKING) -> DataFrame:
    """Price change and normalised price return per row; the first row is 0."""
    part = chunks.split(df, ts, back=1, chunking=chunking)
    w = Window.partitionBy(*chunks.chunk_keys(keys)).orderBy(ts)
    p, prev = F.col(PRICE), F.lag(PRICE).over(w)
    return chunks.core(
        part.withColumns(
            {"price_change_eur_mwh": zero(p - prev), "price_return": zero((p - prev) / at_least(F.abs(prev), floor))}
        )
    )


def attribution(result: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """Net P&L by regime, hour and month in one grouping-sets pass: (keys, dimension, bucket, ...)."""
    rows = result.select(
        *keys,
        "vol_regime",
        "market_regime",
        F.hour(ts).cast("string").alias("hour"),
        F.month(ts).cast("string").alias("month"),
        "net_pnl_eur",
    )
    dims = ("vol_regime", "market_regime", "hour", "month")
    names = [F.col(c) for c in (*keys, *dims)]
    sets = [[*keys, d] for d in dims]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(
        F.grouping_id().alias("_g"),
        F.sum("net_pnl_eur").alias("pnl_sum"),
        F.avg("net_pnl_eur").alias("pnl_mean"),
        F.count("net_pnl_eur").alias("n"),
    )
    n = len(dims)
    full = (1 << n) - 1
    which, bucket = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        hit = F.col("_g") == F.lit(full & ~(1 << (n - 1 - i)))
        which = F.when(hit, F.lit(d)).otherwise(which)
        bucket = F.when(hit, F.col(d)).otherwise(bucket)
    return grouped.select(*keys, which.alias("dimension"), bucket.alias("bucket"), "pnl_sum", "pnl_mean", "n")


def family_pnl(result: DataFrame, keys=KEYS) -> DataFrame:
    """P&L by signal family: position x forward change x size of the signal."""
    move = F.col("position") * F.col("forward_price_change_eur_mwh")
    return result.groupBy(*keys).agg(
        *[
            F.sum(move * F.abs(zero(F.col(f"{f}_signal")))).alias(f"{f}_pnl")
            for f in ("forecast", "mean_reversion", "fundamental")
        ]
    )


def decomposition(result: DataFrame, cfg: BacktestConfig = BacktestConfig(), keys=KEYS) -> DataFrame:
    ret = zero(F.col("strategy_return"))
    return result.groupBy(*keys).agg(
        F.avg(ret).alias("mean_return"),
        F.stddev_samp(ret).alias("return_volatility"),
        F.avg((ret > 0).cast("double")).alias("hit_rate"),
        zero(F.avg(F.when(ret > 0, ret))).alias("avg_win"),
        zero(F.avg(F.when(ret < 0, ret))).alias("avg_loss"),
        F.sum(F.col(COSTS[0]) + F.col(COSTS[1]) + F.col(COSTS[2]) + F.col(COSTS[3])).alias("cost_drag_eur"),
        sharpe(ret, cfg.annualization).alias("annualized_sharpe"),
    )


def turnover_summary(result: DataFrame, keys=KEYS) -> DataFrame:
    t = zero(F.col("turnover"))
    return result.groupBy(*keys).agg(
        F.avg(t).alias("mean_turnover"), F.max(t).alias("max_turnover"), F.sum(t).alias("total_turnover")
    )


def decision_distribution(result: DataFrame, keys=KEYS) -> DataFrame:
    return result.groupBy(*keys).agg(
        *[F.count_if(F.col("decision") == d).alias(f"{d.lower()}_count") for d in ("LONG", "SHORT", "HOLD")]
    )


def analytics(result: DataFrame, cfg: BacktestConfig = BacktestConfig(), keys=KEYS, ts: str = TS) -> DataFrame:
    """One nested row per series: counts, turnover, accuracy, costs, decomposition and the settings."""
    ret = zero(F.col("strategy_return"))
    known = F.col("future_price_eur_mwh").isNotNull()
    d = F.col("decision")
    move = F.col("position") * F.col("forward_price_change_eur_mwh")
    count = lambda c: F.count_if(flag(c))
    s = cfg.signal
    return result.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.struct(*[count(d == x).alias(x) for x in ("LONG", "SHORT", "HOLD")]).alias("decision_distribution"),
        F.struct(
            F.avg(zero(F.col("turnover"))).alias("mean_turnover"),
            F.max(zero(F.col("turnover"))).alias("max_turnover"),
            F.sum(zero(F.col("turnover"))).alias("total_turnover"),
        ).alias("turnover_summary"),
        F.max_by("equity_curve", ts).alias("final_equity"),
        F.max_by("cumulative_returns", ts).alias("cumulative_return"),
        F.struct(
            count(known).alias("evaluable_rows"),
            zero(F.avg(F.when(known, F.col("directional_correct").cast("double")))).alias("directional_accuracy"),
            zero(F.avg(F.when(known, F.col("pnl_positive").cast("double")))).alias("pnl_positive_rate"),
            count(F.col("accuracy_status") == "correct").alias("correct_count"),
            count(F.col("accuracy_status") == "incorrect").alias("incorrect_count"),
            count(F.col("accuracy_status") == "pending").alias("pending_count"),
        ).alias("accuracy_summary"),
        F.max("reference_price_eur_mwh").alias("reference_price_eur_mwh"),
        F.max("exposure_mwh").alias("exposure_mwh"),
        F.struct(*[F.sum(c).alias(c) for c in COSTS]).alias("execution_costs"),
        F.struct(
            F.avg(ret).alias("mean_return"),
            F.stddev_samp(ret).alias("return_volatility"),
            F.avg((ret > 0).cast("double")).alias("hit_rate"),
            zero(F.avg(F.when(ret > 0, ret))).alias("avg_win"),
            zero(F.avg(F.when(ret < 0, ret))).alias("avg_loss"),
            sharpe(ret, cfg.annualization).alias("annualized_sharpe"),
        ).alias("sharpe_decomposition"),
        F.struct(
            *[
                F.sum(move * F.abs(zero(F.col(f"{f}_signal")))).alias(f)
                for f in ("forecast", "mean_reversion", "fundamental")
            ]
        ).alias("signal_family_pnl"),
        F.struct(
            F.lit(max(cfg.notional, 1.0)).alias("initial_equity_eur"),
            F.lit(cfg.horizon).alias("accuracy_horizon_steps"),
            F.lit(cfg.hold_tolerance).alias("hold_tolerance_pct"),
            F.lit(s.new_signal).alias("enable_new_signal"),
            F.lit(cfg.execution_delay).alias("enable_execution_delay"),
            F.lit(s.volatility_window).alias("signal_volatility_window_hours"),
            F.lit(s.equilibrium_window).alias("signal_equilibrium_window_hours"),
            F.lit(s.position_scale_k).alias("signal_position_scale_k"),
            F.lit(s.imbalance_scale).alias("signal_imbalance_scale"),
            F.lit(s.long_edge).alias("long_price_edge_threshold"),
            F.lit(s.short_edge).alias("short_price_edge_threshold"),
            F.lit(s.volatility_scaling).alias("enable_volatility_scaling"),
            F.lit(s.regime_switching).alias("enable_regime_switching"),
            F.lit(s.position_limit).alias("position_limit"),
            F.lit(cfg.max_position_change).alias("max_position_change"),
        ).alias("settings"),
    )


def forecast_errors(scored: DataFrame, pairs=((PRED_PRICE, PRICE),), keys=KEYS) -> DataFrame:
    """MAE and RMSE per (prediction, actual) pair."""
    aggs = []
    for pred, actual in pairs:
        e = F.col(pred) - F.col(actual)
        aggs += [F.avg(F.abs(e)).alias(f"{actual}_mae"), F.sqrt(F.avg(e * e)).alias(f"{actual}_rmse")]
    return scored.groupBy(*keys).agg(*aggs)
