"""Baseline forecasts, computed once per series as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT_CHUNKING, Chunking
from ..functions import chunks
from ..functions.columns import zero
from ..functions.staging import stage
from ..functions.windows import ordered
from ..schema import (
    DAY_AHEAD, DEMAND, KEYS, PRED_DEMAND, PRED_PRICE, PRED_RENEWABLE, PRICE, RENEWABLE, SPREAD, TS,
)

TARGETS = {PRED_PRICE: PRICE, PRED_DEMAND: DEMAND, PRED_RENEWABLE: RENEWABLE}
BASELINES = ("persistence", "seasonal", "naive_mean_reversion", "zero_signal")


def _actual(df: DataFrame, pred: str) -> Column:
    actual = TARGETS[pred]
    return F.col(actual) if actual in df.columns else F.col(pred)


def lagged(df: DataFrame, w) -> dict[str, Column]:
    """Previous value of each target, the own value on the first row or after a gap."""
    made = {}
    for pred in TARGETS:
        x = _actual(df, pred)
        made[f"_last_{pred}"] = F.coalesce(F.lag(x).over(w), x)
    return made


def seasonal_profile(
    df: DataFrame, values: dict[str, Column], fallback: dict[str, Column], keys=KEYS, ts: str = TS
) -> DataFrame:
    """Mean of all earlier rows of the same weekday and hour, for each named value of a chunked frame.

    Fallbacks: the mean of all earlier rows, then ``fallback``. Only earlier rows count, also for the
    first row of a weekday and hour. One summary row per chunk and slot, so a series stays split.
    """
    part = stage(df.withColumns({"_dow": F.weekday(ts), "_hour": F.hour(ts)}))
    out = chunks.carry(
        part, keys, ts, moments={f"{n}_slot": v for n, v in values.items()}, by=("_dow", "_hour"),
        include_current=False,
    )
    out = chunks.carry(
        out, keys, ts, moments={f"{n}_past": v for n, v in values.items()}, include_current=False, source=part
    )
    out = out.withColumns({n: F.coalesce(f"{n}_slot_mean", f"{n}_past_mean", fallback[n]) for n in values})
    extra = [f"{n}_{a}_{b}" for n in values for a in ("slot", "past") for b in ("n", "mean", "std")]
    return out.drop("_dow", "_hour", *extra)


def with_baselines(df: DataFrame, keys=KEYS, ts: str = TS, chunking: Chunking = DEFAULT_CHUNKING) -> DataFrame:
    """All baseline forecasts as columns ``<baseline>__<prediction>``."""
    part = chunks.split(df, ts, back=1, chunking=chunking)
    part = chunks.core(part.withColumns(lagged(part, ordered(chunks.chunk_keys(keys), ts))), keep_chunk=True)
    part = seasonal_profile(
        part,
        {f"_season_{p}": _actual(df, p) for p in TARGETS},
        {f"_season_{p}": F.col(f"_last_{p}") for p in TARGETS},
        keys, ts,
    ).drop(chunks.CHUNK)
    spread = zero(F.col(SPREAD)) if SPREAD in df.columns else F.lit(0.0)
    day_ahead = F.col(DAY_AHEAD) if DAY_AHEAD in df.columns else F.col(PRICE)
    made = {}
    for pred in TARGETS:
        made[f"persistence__{pred}"] = F.col(f"_last_{pred}")
        made[f"seasonal__{pred}"] = F.col(f"_season_{pred}")
        made[f"naive_mean_reversion__{pred}"] = F.col(f"_last_{pred}")
        made[f"zero_signal__{pred}"] = _actual(df, pred)
    made[f"naive_mean_reversion__{PRED_PRICE}"] = day_ahead - 0.5 * spread
    made[f"zero_signal__{PRED_PRICE}"] = F.col(PRICE)
    return part.withColumns(made).drop(*[f"{x}_{p}" for x in ("_last", "_season") for p in TARGETS])


def baseline_frame(df: DataFrame, name: str, keys=KEYS, ts: str = TS, chunking=DEFAULT_CHUNKING) -> DataFrame:
    """The scored frame with its predictions replaced by one baseline's."""
    if name not in BASELINES:
        raise ValueError(f"unknown baseline: {name}")
    out = with_baselines(df, keys, ts, chunking).withColumns({p: F.col(f"{name}__{p}") for p in TARGETS})
    return out.drop(*[f"{b}__{p}" for b in BASELINES for p in TARGETS])
