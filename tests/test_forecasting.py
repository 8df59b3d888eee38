"""Pooled folds cut by time, and the recurrent forecaster."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.config import ForecastConfig
from wattline.functions import recurrent as net
from wattline.functions.staging import stage
from wattline.operators import forecast, recurrent
from wattline.plans import base, catalog
from wattline.schema import DEMAND, KEYS, PRICE, RENEWABLE, TS

START = dt.datetime(2024, 1, 1)
FC = ForecastConfig(train_days=4, test_days=2)
TINY = forecast.BoostParams(trees=3, depth=2, step=0.3, row_share=1.0, column_share=1.0)


def panel(n, offset, name, seed, changed_from=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 2))
    price = 50 + 10 * x[:, 0] + 5 * np.roll(x[:, 0], 1) + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame(
        {"series_id": name, TS: [START + dt.timedelta(hours=offset + i) for i in range(n)], "a": x[:, 0], "b": x[:, 1],
         PRICE: price, DEMAND: 1000 + 50 * x[:, 1], RENEWABLE: 20 + x[:, 0]}
    )
    if changed_from is not None:
        late = pdf[TS] >= START + dt.timedelta(hours=changed_from)
        pdf.loc[late, ["a", "b", PRICE, DEMAND, RENEWABLE]] += 500.0
    return pdf


def staggered(spark, changed_from=None):
    """Series B starts four days after A: by row number its train window would reach beyond A's test window."""
    pdf = pd.concat([panel(240, 0, "A", 1), panel(240, 96, "B", 2, changed_from)], ignore_index=True)
    return stage(spark.createDataFrame(pdf))


def predictions(df):
    return {(r["series_id"], r[TS]): r["p"] for r in df.collect()}


@pytest.mark.parametrize("early", [False, True])
def test_staggered_series_never_train_on_later_hours(spark, early):
    cut = 96 + 48
    fit = lambda df: predictions(forecast.fit_boosted(df, ["a", "b"], PRICE, "p", FC, TINY, early_stopping=early, final=False)[0])
    before, after = fit(staggered(spark)), fit(staggered(spark, cut))
    moment = START + dt.timedelta(hours=cut)
    earlier = {k for k in before if k[1] < moment}
    assert {k[0] for k in earlier} == {"A", "B"} and len(earlier) == 48 * 2
    assert all(before[k] == after[k] for k in earlier)
    assert any(before[k] != after[k] for k in before if k[1] >= moment)


def test_pruning_and_tuning_see_the_first_window_only(spark):
    cut = 96
    for pick in (
        lambda df: forecast.prune_features(df, ["a", "b"], FC, pooled=True).orderBy("position").collect(),
        lambda df: forecast.tune(df, ["a", "b"], PRICE, FC, (TINY, forecast.BoostParams(2, 1, 0.1, 1.0, 1.0))),
    ):
        assert pick(staggered(spark)) == pick(staggered(spark, cut))


def test_boosted_forecast_runs_the_default_trees_on_all_kept_features(spark, monkeypatch):
    hours = (base.FOLDS.train_days + 2 * base.FOLDS.test_days) * 24
    parts = [panel(hours, 0, name, seed) for name, seed in (("A", 1), ("B", 2))]
    rng = np.random.default_rng(5)
    for p in parts:
        p[[*catalog.REGRESSORS, "humidity_pct_anomaly"]] = rng.normal(size=(hours, 5))
        p["flat"] = 7.0
    rows = stage(spark.createDataFrame(pd.concat(parts, ignore_index=True)))
    fits, used, booster, frame = [], [], forecast.booster, forecast.fold_frame

    def recorded(target, params, seed, out="_pred"):
        fits.append((target, params))
        return booster(target, TINY, seed, out)

    def framed(df, cols, *rest):
        used.append(list(cols))
        return frame(df, cols, *rest)

    monkeypatch.setattr(forecast, "booster", recorded)
    monkeypatch.setattr(forecast, "fold_frame", framed)
    monkeypatch.setattr(catalog, "_features", lambda spark, sf: rows)
    scored = catalog.boosted_forecast(spark, "").toPandas()
    assert len(scored) == 2 * 2 * base.FOLDS.test_days * 24
    assert scored[list(forecast.TARGETS)].notna().all(axis=None)
    assert sorted(t for t, _ in fits) == sorted([PRICE, DEMAND, RENEWABLE] * 2)
    assert {p for _, p in fits} == {forecast.BoostParams()}
    assert (forecast.BoostParams().trees, forecast.BoostParams().depth) == (300, 6)
    assert len(used) == 1 and set(used[0]) == {"a", "b", *catalog.REGRESSORS, "humidity_pct_anomaly"}


def test_boosted_predictions_do_not_depend_on_how_rows_are_dealt_out(spark):
    params = forecast.BoostParams(trees=3, depth=2, step=0.3, row_share=0.7, column_share=0.5)
    fit = lambda df: predictions(forecast.fit_boosted(df, ["a", "b"], PRICE, "p", FC, params, final=False)[0])
    rows = staggered(spark)
    one, many = fit(rows.orderBy(TS).coalesce(1)), fit(rows.orderBy(F.desc(TS)).repartition(5))
    assert len(one) == 480 - 96 and one == many


def test_fits_run_in_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    rows = staggered(spark).repartition(40)
    monkeypatch.setattr(forecast, "FIT_ROWS", 100)
    packed = forecast.packed(rows)
    assert packed.rdd.getNumPartitions() == 5 and packed.count() == 480
    assert forecast.packed(rows.limit(0)).rdd.getNumPartitions() <= 1


def test_time_folds(spark):
    clock = forecast.time_folds(staggered(spark), FC)
    assert (clock.train, clock.test, clock.count) == (96, 48, 5)
    with pytest.raises(ValueError):
        forecast.time_folds(spark.createDataFrame(panel(48, 0, "A", 1)), FC)
    with pytest.raises(ValueError):
        forecast.time_folds(spark.createDataFrame(panel(48, 0, "A", 1)).limit(0), FC)


def test_gradients_against_differences():
    p = net.RecurrentParams(steps=3, hidden=4, head=3, dropout=0.0)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 3, 2)), rng.normal(size=7)
    n = net.Network(2, p)
    n.w = {k: v.astype(float) for k, v in n.w.items()}
    _, grad = n.gradients(x, y)
    loss = lambda: float(np.mean((n.forward(x)[0] - y) ** 2))
    for name, w in n.w.items():
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            old = w[at]
            w[at] = old + 1e-4
            up = loss()
            w[at] = old - 1e-4
            down = loss()
            w[at] = old
            assert grad[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-5), name


def test_sequences_scaling_and_best_state():
    x = np.arange(8, dtype=np.float32).reshape(4, 2)
    assert net.sequences(x, 3)[1].tolist() == [[0, 0], [0, 1], [2, 3]] and net.sequences(x, 1)[:, 0].tolist() == x.tolist()
    s = net.Scaler(np.array([[1.0, 5.0], [3.0, 5.0], [np.nan, 5.0]]))
    assert s(np.array([[2.0, 5.0], [np.nan, 6.0]])).tolist() == [[0, 0], [0, 1]]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2, 1)).astype(np.float32)
    y = np.where(np.arange(60) < 45, 3 * x[:, -1, 0], -3 * x[:, -1, 0])
    model, log = net.fit(x, y, net.RecurrentParams(rate=0.05, epochs=200, dropout=0.0))
    tail = log["validation_rows"]
    assert log["stopped"] and log["epochs"] < 200 and tail == 9
    kept = float(np.mean((model.forward(x[-tail:])[0] - y[-tail:]) ** 2))
    assert kept == pytest.approx(log["best_loss"], rel=1e-5)
    _, short = net.fit(x[:20], y[:20], net.RecurrentParams())
    assert short == {"epochs": 10, "stopped": False, "best_loss": None, "validation_rows": 0}


def test_recurrent_forecast_learns_from_earlier_steps(spark):
    fc = ForecastConfig(train_days=20, test_days=5)
    df = stage(spark.createDataFrame(pd.concat([panel(900, 0, "A", 3), panel(700, 50, "B", 4)], ignore_index=True)))
    made = recurrent.fit_recurrent(df, ["a"], fc, net.RecurrentParams(steps=2, rate=0.02, epochs=150, dropout=0.0))
    got = made.predictions.join(df, [*KEYS, TS]).toPandas()
    assert len(got) == 120 * 3 + 120 * 1
    error = (got["pred_price_eur_mwh"] - got[PRICE]).abs().mean()
    # Without the row before, the mean error cannot be below that of its share: 5 * E|x| = 4.
    assert error < 2.5
    history = made.history.toPandas()
    assert len(history) == 4 * 3 and (history["epochs"] > 0).all()


def test_recurrent_folds_are_causal_and_bounded(spark):
    fc = ForecastConfig(train_days=4, test_days=2)
    rows = recurrent.fold_rows(staggered(spark).select(*KEYS, TS), fc)
    sizes = rows.groupBy("series_id", "fold").agg(F.count_if("_test").alias("test"), F.count_if(~F.col("_test")).alias("train"), F.max(F.when(~F.col("_test"), F.col(TS))).alias("a"), F.min(F.when(F.col("_test"), F.col(TS))).alias("b")).collect()
    assert len(sizes) == 6 and all((r["train"], r["test"]) == (96, 48) and r["a"] < r["b"] for r in sizes)
    p = net.RecurrentParams(epochs=3)
    fit = lambda df: {(r["series_id"], r[TS]): r["pred_price_eur_mwh"] for r in recurrent.fit_recurrent(df, ["a", "b"], fc, p).predictions.collect()}
    before, after = fit(staggered(spark)), fit(staggered(spark, 96 + 96 + 48))
    earlier = [k for k in before if k[1] < START + dt.timedelta(hours=96 + 96 + 48)]
    assert earlier and all(before[k] == after[k] for k in earlier)
