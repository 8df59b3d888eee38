"""Walk-forward recurrent forecasts: every (series, fold) is one bounded group, and all are trained side by side."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import ForecastConfig
from ..functions import chunks
from ..functions.recurrent import RecurrentParams, Scaler, fit, sequences
from ..functions.staging import stage
from ..schema import KEYS, TS
from .forecast import ROW, TARGETS, selected_columns, series_lengths


@dataclass(frozen=True)
class RecurrentFit:
    predictions: DataFrame
    history: DataFrame


def fold_rows(df: DataFrame, fc: ForecastConfig = ForecastConfig(), keys=KEYS, ts: str = TS) -> DataFrame:
    """Rows once per fold they belong to, with ``fold`` and ``_test`` (false: train).

    Which folds follow from a row's number alone; a row is in at most train_days / test_days + 2 of them, so a group
    (series, fold) is as long as one train and one test window whatever the length of the series.
    """
    test = fc.test_days * 24
    lengths = series_lengths(df, keys).withColumnRenamed("rows", "_rows")
    rows = chunks.attach(chunks.number_rows(df, keys, ts), lengths, keys, ts)
    train = F.least(F.lit(fc.train_days * 24), F.greatest(F.col("_rows") - test, F.lit(0)))
    rows = rows.withColumn("_train", train.cast("long")).where("_train > 0")
    first = F.greatest(F.floor((F.col(ROW) - F.col("_train") - test) / test) + 1, F.lit(0))
    last = F.least(F.floor(F.col(ROW) / test), F.floor((F.col("_rows") - test - F.col("_train")) / test))
    rows = rows.where(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    return rows.withColumn("_test", F.col(ROW) >= F.col("fold") * test + F.col("_train")).drop("_rows", "_train")


def fit_recurrent(
    df: DataFrame, cols, fc: ForecastConfig = ForecastConfig(), params: RecurrentParams = RecurrentParams(),
    targets=None, keys=KEYS, ts: str = TS,
) -> RecurrentFit:
    """Out-of-fold predictions of all targets, and how each training went.

    Features and target are scaled by the train window of the fold alone. Train rows without the target are left
    out of its training; a fold without enough of them predicts NULL. History has one row per series, fold, target.
    """
    targets, cols, keys = dict(targets or TARGETS), list(cols), list(keys)
    ys = list(targets.values())
    need = list(dict.fromkeys([*cols, *ys]))
    rows = fold_rows(df.select(*keys, ts, *[F.col(c).cast("double").alias(c) for c in need]), fc, keys, ts)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        test = pdf["_test"].to_numpy(dtype=bool)
        x = pdf[cols].to_numpy(dtype=float)
        x = sequences(Scaler(x[~test])(x), params.steps)
        out = pdf.loc[test, [*keys, "fold", ts]].copy()
        history = {}
        for pred, target in targets.items():
            y = pdf[target].to_numpy(dtype=float)
            known = ~test & np.isfinite(y)
            if known.sum() < 2:
                out[pred], history[pred] = np.nan, (0, False, None, 0)
                continue
            scale = Scaler(y[known][:, None])
            net, log = fit(x[known], scale(y[known][:, None])[:, 0], params)
            out[pred] = net.forward(x[test])[0].astype(float) * scale.std[0] + scale.mean[0]
            history[pred] = (log["epochs"], log["stopped"], log["best_loss"], log["validation_rows"])
        for pred, values in history.items():
            for name, value in zip(("epochs", "stopped", "loss", "rows"), values):
                out[f"_{name}_{pred}"] = [value] * len(out)
        return out

    ddl = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    logs = ", ".join(f"{p} double" for p in targets) + "".join(
        f", _epochs_{p} int, _stopped_{p} boolean, _loss_{p} double, _rows_{p} int" for p in targets
    )
    made = stage(rows.groupBy(*keys, "fold").applyInPandas(train, f"{ddl}fold long, {ts} timestamp, {logs}"))
    null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    predictions = made.select(*keys, ts, *[null(p) for p in targets])
    entries = [
        F.struct(
            F.lit(t).alias("target"), F.col(f"_epochs_{p}").alias("epochs"), F.col(f"_stopped_{p}").alias("early_stopped"),
            F.when(~F.isnan(f"_loss_{p}"), F.col(f"_loss_{p}")).alias("best_validation_loss"), F.col(f"_rows_{p}").alias("validation_rows"),
        )
        for p, t in targets.items()
    ]
    per_fold = made.groupBy(*keys, "fold").agg(F.first(F.array(*entries)).alias("e"))
    return RecurrentFit(predictions, per_fold.select(*keys, "fold", F.inline("e")))


def training_summary(history: DataFrame, keys=KEYS) -> DataFrame:
    """Mean epochs and share of early stops over the folds of each series and target."""
    return history.groupBy(*keys, "target").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("epochs").alias("mean_fold_epochs"),
        F.avg(F.col("early_stopped").cast("double")).alias("fold_early_stop_rate"),
    )


def train_recurrent(
    features: DataFrame, fc: ForecastConfig = ForecastConfig(), keys=KEYS, ts: str = TS,
    params: RecurrentParams = RecurrentParams(), cols=None,
) -> DataFrame:
    """Scored rows with the three predictions; rows outside the test windows are left out."""
    cols = list(cols or selected_columns(features, fc, keys, ts))
    made = fit_recurrent(features, cols, fc, params, keys=keys, ts=ts).predictions
    return features.join(made, [*keys, ts]).na.drop(subset=list(TARGETS))
