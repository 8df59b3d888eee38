"""Forecasts to trading signals.

:func:`market_state` holds everything that needs windows and depends on the market alone. The rest
is a projection over it, so several strategies share one window pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT_CHUNKING, Chunking, SignalConfig
from ..functions import chunks, order_stats
from ..functions.columns import at_least, clip, decision_label, flag, num, zero
from ..functions.staging import stage
from ..functions.windows import ordered, rolling_mean, rolling_std
from ..schema import (
    DAY_AHEAD, DEMAND, INTRADAY, KEYS, PRED_DEMAND, PRED_PRICE, PRED_RENEWABLE, PRICE, RENEWABLE, SCORED_REQUIRED,
    SPREAD, TS, require_columns,
)

EPS = 1e-6


def _optional(df: DataFrame, name: str, fallback: str) -> Column:
    return F.col(name) if name in df.columns else F.col(fallback)


def base_columns(df: DataFrame) -> DataFrame:
    """Levels that do not depend on a forecast; absent optional columns fall back."""
    out = df.withColumns({DAY_AHEAD: _optional(df, DAY_AHEAD, PRICE), INTRADAY: _optional(df, INTRADAY, PRICE)})
    demand, renewable = _optional(df, DEMAND, PRED_DEMAND), _optional(df, RENEWABLE, PRED_RENEWABLE)
    return out.withColumns({"net_load_mw": demand / 1000.0 - renewable, SPREAD: F.col(INTRADAY) - F.col(DAY_AHEAD)})


def market_state(
    df: DataFrame, cfg: SignalConfig = SignalConfig(), keys=KEYS, ts: str = TS,
    chunking: Chunking = DEFAULT_CHUNKING, ahead: int = 0, extra=None, keep_chunk: bool = False,
) -> DataFrame:
    """Volatility, equilibria, spread volatility and regimes of each series.

    Warm-up rows use statistics of the rows so far, never later ones. ``extra`` (window -> columns)
    adds row-frame columns of the caller in the same pass; ``ahead`` is their forward reach.
    """
    vw, ew = cfg.volatility_window, cfg.equilibrium_window
    part = chunks.split(base_columns(df), ts, back=max(vw, ew), ahead=ahead, chunking=chunking)
    w = ordered(chunks.chunk_keys(keys), ts)
    p, load, spr = F.col(PRICE), F.col("net_load_mw"), F.col(SPREAD)
    part = part.withColumns(
        {
            "price_trend": zero(p - F.lag(p).over(w)),
            "_vol": rolling_std(p, w, vw, max(2, vw // 2)),
            "_load_eq": rolling_mean(load, w, ew, 6),
            "_spread_vol": rolling_std(spr, w, vw, 4),
            **(extra(w) if extra else {}),
        }
    )
    part = order_stats.rolling_quantiles(part, chunks.chunk_keys(keys), ts, {"_eq": (PRICE, 0.5, ew, max(6, ew // 3))})
    core = stage(chunks.core(part, keep_chunk=True))
    # Before the first full window the equilibrium is the median of all rows so far.
    started = core.groupBy(*keys).agg(F.min(F.when(F.col("_eq").isNotNull(), F.col(ts))).alias("_ready_at"))
    early = chunks.attach(core.select(*keys, chunks.CHUNK, ts, PRICE), started, keys, ts)
    early = stage(early.where(F.col("_ready_at").isNull() | (F.col(ts) < F.col("_ready_at"))).drop("_ready_at"))
    median = order_stats.expanding_median(early, keys, ts, PRICE, "_median")
    filled = ["_vol", "_eq", "_load_eq", "_spread_vol"]
    core = chunks.carry(
        core, keys, ts, fills={c: F.col(c) for c in filled}, moments={"_p": p, "_l": load, "_d": spr}
    )
    core = core.join(median, [*chunks.chunk_keys(keys), ts], "left").withColumns(
        {
            "rolling_volatility": F.coalesce("_vol", "_p_std"),
            "equilibrium_price_eur_mwh": F.coalesce("_eq", "_median"),
            "net_load_equilibrium": F.coalesce("_load_eq", "_l_mean"),
            "spread_volatility": F.coalesce("_spread_vol", "_d_std"),
        }
    )
    core = core.drop(*filled, "_median", *[f"_{x}_{y}" for x in "pld" for y in ("n", "mean", "std")])
    # Frames over the finished volatility need a halo of their own. Volatility is never NULL again
    # once it has a value, so the quantile is complete from its sixth row on and needs no fill.
    part = chunks.split(core.drop(chunks.CHUNK), ts, back=max(vw, ew), chunking=chunking)
    vol = F.col("rolling_volatility")
    part = part.withColumns(
        {
            "_trend": rolling_mean(F.col("price_trend"), w, vw, 4),
            "_vol_mean": rolling_mean(vol, w, vw, 4),
        }
    )
    part = order_stats.rolling_quantiles(part, chunks.chunk_keys(keys), ts, {"_q": ("rolling_volatility", cfg.regime_quantile, ew, 6)})
    trend = flag(F.abs("_trend") > zero(F.col("_vol_mean")) * 0.3)
    return (
        chunks.core(part, keep_chunk=keep_chunk)
        .withColumns(
            {
                "vol_regime": F.when(flag(vol > F.col("_q")), F.lit("high_vol")).otherwise(F.lit("low_vol")),
                "market_regime": F.when(trend, F.lit("trend")).otherwise(F.lit("mean_revert")),
            }
        )
        .drop("_q", "_trend", "_vol_mean")
    )


def apply_signal(
    state: DataFrame, cfg: SignalConfig = SignalConfig(), new_signal: Column | None = None,
    zero_signal: Column | None = None,
) -> DataFrame:
    """Signals, sizing and labels as projections over :func:`market_state` plus forecast columns.

    ``new_signal`` and ``zero_signal`` may be columns, so rows of different strategies share a frame.
    """
    new = F.lit(cfg.new_signal) if new_signal is None else new_signal
    off = F.lit(False) if zero_signal is None else zero_signal
    scale = max(cfg.imbalance_scale, EPS)
    out = state.withColumns(
        {
            "pred_price_delta": F.col(PRED_PRICE) - F.col(PRICE),
            "imbalance_pred": F.col(PRED_DEMAND) / 1000.0 - F.col(PRED_RENEWABLE),
        }
    )
    delta, vol, imb = F.col("pred_price_delta"), F.col("rolling_volatility"), F.col("imbalance_pred")
    decision = decision_label(delta, cfg.long_edge, cfg.short_edge)
    spread_signal = F.col(SPREAD) / (F.col("spread_volatility") + EPS)
    pick = lambda a, b: F.when(new, a).otherwise(b)
    out = out.withColumns(
        {
            "forecast_signal": pick(delta / (vol + EPS), delta),
            "mean_reversion_signal": pick(
                -(F.col(PRICE) - F.col("equilibrium_price_eur_mwh")) / (vol + EPS), F.lit(0.0)
            ),
            "fundamental_signal": pick((imb - F.col("net_load_equilibrium")) / scale, imb / scale),
            "spread_signal": spread_signal,
            "price_edge_signal": delta,
            "price_edge_decision": decision,
            "price_edge_strength": at_least(delta - F.lit(cfg.long_edge), 0.0)
            + at_least(F.lit(cfg.short_edge) - delta, 0.0),
            "_direction": F.when(decision == "LONG", 1.0).when(decision == "SHORT", -1.0).otherwise(0.0),
            "vol_regime": pick(F.col("vol_regime"), F.lit("low_vol")),
            "market_regime": pick(F.col("market_regime"), F.lit("trend")),
        }
    )
    fc, mr, fu = F.col("forecast_signal"), F.col("mean_reversion_signal"), F.col("fundamental_signal")
    wf, wm, wu = cfg.forecast_weight, cfg.mean_reversion_weight, cfg.fundamental_weight
    if cfg.regime_switching:
        mix = F.when(F.col("market_regime") == "trend", wf * fc + wu * fu).otherwise(wm * mr + wu * fu)
    else:
        mix = wf * fc + wm * mr + wu * (fu - 0.25 * F.col("spread_signal"))
    side, strength = F.col("_direction"), F.col("price_edge_strength")
    base = side * F.tanh(strength / max(cfg.position_scale_k, EPS))
    sized = base * (1.0 + 0.25 * F.tanh(at_least(side * fu, 0.0)))
    if cfg.volatility_scaling:
        sized = sized / (1.0 + vol)
    sized = F.when(F.col("vol_regime") == "high_vol", sized * 0.65).otherwise(sized)
    blank = lambda x: F.when(off, F.lit(0.0)).otherwise(x)
    out = out.withColumns(
        {
            "ensemble_signal": blank(pick(zero(mix), 0.06 * imb + 0.4 * delta)),
            "combined_signal": blank(pick(side * strength, delta)),
            "signal_z_score": blank(pick(side * strength, F.lit(0.0))),
            "signal_strength": blank(strength),
            "target_position_raw": blank(pick(sized, base)),
            "forecast_signal": blank(fc),
            "mean_reversion_signal": blank(mr),
            "fundamental_signal": blank(fu),
            "target_decision": F.when(off, F.lit("HOLD")).otherwise(F.col("price_edge_decision")),
        }
    )
    limit = abs(cfg.position_limit)
    out = out.withColumn("target_position_capped", clip(num("target_position_raw"), -limit, limit))
    return out.withColumns(
        {
            "target_position": zero(clip(F.col("target_position_capped"), -1.0, 1.0)),
            "recommended_decision": F.col("target_decision"),
        }
    ).drop("_direction")


def signal_frame(
    scored: DataFrame, cfg: SignalConfig = SignalConfig(), keys=KEYS, ts: str = TS,
    chunking: Chunking = DEFAULT_CHUNKING,
) -> DataFrame:
    """Signals and target positions of one strategy."""
    require_columns(scored, SCORED_REQUIRED)
    return apply_signal(market_state(scored, cfg, keys, ts, chunking), cfg)
