"""Ordered folds over long series: summarise chunks, chain the summaries, replay the chunks.

Step 1 maps every chunk, in parallel, to the effect it has on an unknown start state. Step 2 walks
over one small row per chunk of a series and finds each chunk's start state. Step 3 replays all
chunks in parallel. The result is that of one ordered pass over the series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import chunks, maps
from ..functions.columns import clip, zero
from ..functions.staging import stage
from ..schema import KEYS, TS

EQUITY_FLOOR = 1e-6
RETURN_CAP = 1.0 - EQUITY_FLOOR


def _ddl(df: DataFrame, cols) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def _head(pdf: pd.DataFrame, cols) -> dict:
    return {c: [pdf[c].iloc[0]] for c in cols}


def position_ramp(
    df: DataFrame, max_change: float, limit: float, keys=KEYS, ts: str = TS, target: str = "target_position"
) -> DataFrame:
    """Move the position towards its target by at most ``max_change`` per row, from 0.

    ``df`` is chunked. Returns (keys, chunk, ts) with ``target_position_constrained``, the two
    positions before it (``_before``, ``_before2``) and ``liquidity_clipped``.
    """
    limit = abs(limit)
    k = chunks.chunk_keys(keys)
    wanted = zero(clip(F.col(target), -limit, limit))
    rows = df.select(*k, ts, wanted.alias("_target"))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.sort_values(ts)["_target"].to_numpy()
        xs, ys = maps.ramp_map(t[:-1].tolist(), max_change, limit)
        return pd.DataFrame({**_head(pdf, k), "xs": [xs], "ys": [ys], "last": [float(t[-1])]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(chunks.CHUNK)
        now, prior, before, before2 = 0.0, 0.0, [], []
        for xs, ys, last in zip(pdf["xs"], pdf["ys"], pdf["last"]):
            before.append(now)
            before2.append(prior)
            prior = maps.evaluate(np.asarray(xs), np.asarray(ys), now)
            now = maps.ramp_step(prior, last, max_change, limit)
        return pdf[k].assign(_start=before, _start2=before2)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        targets = pdf["_target"].to_numpy()
        path = maps.ramp_path(targets.tolist(), float(pdf["_start"].iloc[0]), max_change, limit)
        out = pdf[[*k, ts]].copy()
        out["target_position_constrained"] = path[1:]
        out["_before"] = path[:-1]
        out["_before2"] = np.concatenate([[float(pdf["_start2"].iloc[0])], path[:-2]])
        out["liquidity_clipped"] = np.abs(targets - path[:-1]) > max_change
        return out

    group = _ddl(df, k)
    summary = rows.groupBy(*k).applyInPandas(summarise, f"{group}, xs array<double>, ys array<double>, last double")
    start = summary.groupBy(*keys).applyInPandas(chain, f"{group}, _start double, _start2 double")
    return rows.join(start, k).groupBy(*k).applyInPandas(
        replay,
        f"{_ddl(df, [*k, ts])}, target_position_constrained double, _before double, _before2 double, "
        "liquidity_clipped boolean",
    )


def equity_curve(
    df: DataFrame, pnl: str = "net_pnl_eur", start: float = 10000.0, keys=KEYS, ts: str = TS
) -> DataFrame:
    """Equity with the period return clipped to +-(1 - 1e-6) and a floor of 1e-6.

    ``df`` is chunked. Adds ``strategy_return``, ``pnl`` and ``equity_eur``. As long as every loss or
    gain is smaller than the equity before it, equity is the start plus a running sum; Spark checks
    that per series. Only series that break it are folded row by row.
    """
    start = max(float(start), 1.0)
    k = chunks.chunk_keys(keys)
    rows = df.select(*k, ts, zero(F.col(pnl)).alias("_pnl"))
    w = Window.partitionBy(*k).orderBy(ts)
    inside = F.coalesce(F.sum("_pnl").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    need = F.greatest(F.abs("_pnl") / F.lit(RETURN_CAP), F.lit(EQUITY_FLOOR) - F.col("_pnl")) - F.col("_inside")
    parts = (
        rows.withColumn("_inside", inside)
        .groupBy(*k)
        .agg(F.sum("_pnl").alias("_sum"), F.max(need).alias("_need"))
    )
    before = Window.partitionBy(*keys).orderBy(chunks.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    base = F.lit(start) + F.coalesce(F.sum("_sum").over(before), F.lit(0.0))
    starts = (
        parts.withColumn("_base", base)
        .withColumn("_linear", F.min((F.col("_base") >= F.col("_need")).cast("int")).over(whole) == 1)
        .select(*k, "_base", "_linear")
    )
    starts = stage(starts)
    bent = _bent_equity(rows, starts, start, keys, ts)
    out = df.join(starts, k, "left")
    before_row = F.col("_base") + F.coalesce(
        F.sum(zero(F.col(pnl))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    out = out.withColumn("_from", before_row)
    if bent is not None:
        out = out.join(bent, [*k, ts], "left")
        equity = F.coalesce("_bent_equity", F.col("_from") + zero(F.col(pnl)))
        ret = F.coalesce("_bent_return", zero(F.col(pnl)) / F.col("_from"))
        realized = F.coalesce("_bent_pnl", zero(F.col(pnl)))
    else:
        equity, realized = F.col("_from") + zero(F.col(pnl)), zero(F.col(pnl))
        ret = realized / F.col("_from")
    out = out.withColumns({"strategy_return": ret, "pnl": realized, "equity_eur": equity})
    return out.drop("_base", "_linear", "_from", "_bent_equity", "_bent_return", "_bent_pnl")


def _bent_equity(rows: DataFrame, starts: DataFrame, start: float, keys, ts: str):
    """The exact fold for series whose equity ever meets a bound; None when there is no such series."""
    k = chunks.chunk_keys(keys)
    bad = starts.where(~F.col("_linear"))
    if bad.isEmpty():
        return None
    rows = stage(rows.join(bad.select(*k), k, "left_semi"))
    group = _ddl(rows, k)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(ts)["_pnl"].to_numpy()
        xs, ys = maps.equity_map(p.tolist(), EQUITY_FLOOR, RETURN_CAP)
        return pd.DataFrame({**_head(pdf, k), "xs": [xs], "ys": [ys]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(chunks.CHUNK)
        now, begin = start, []
        for xs, ys in zip(pdf["xs"], pdf["ys"]):
            begin.append(now)
            now = max(maps.evaluate(np.asarray(xs), np.asarray(ys), now), EQUITY_FLOOR)
        return pdf[k].assign(_start=begin)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        path, returns = maps.equity_path(pdf["_pnl"].tolist(), float(pdf["_start"].iloc[0]), EQUITY_FLOOR, RETURN_CAP)
        return pdf[[*k, ts]].assign(_bent_equity=path[1:], _bent_return=returns, _bent_pnl=np.diff(path))

    summary = rows.groupBy(*k).applyInPandas(summarise, f"{group}, xs array<double>, ys array<double>")
    begin = summary.groupBy(*keys).applyInPandas(chain, f"{group}, _start double")
    return rows.join(begin, k).groupBy(*k).applyInPandas(
        replay, f"{_ddl(rows, [*k, ts])}, _bent_equity double, _bent_return double, _bent_pnl double"
    )
