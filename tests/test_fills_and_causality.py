"""Fill rules against pandas, and no output before a changed row moves."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattline.operators import baselines, features, gaps, quality, signals
from wattline.schema import KEYS, PRICE, TS, WEATHER_VALUES

START = dt.datetime(2024, 1, 1)


def hourly(spark, columns: dict, series="A"):
    n = len(next(iter(columns.values())))
    clean = lambda v: None if v is None or v != v else float(v)
    data = [
        (series, START + dt.timedelta(hours=i), *[clean(v[i]) for v in columns.values()]) for i in range(n)
    ]
    ddl = f"series_id string, {TS} timestamp, " + ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame(data, ddl)


def market(n, seed=3):
    rng = np.random.default_rng(seed)
    price = 70 + np.cumsum(rng.normal(0, 2, n))
    made = {
        PRICE: price, "demand_kw": 50000 + rng.normal(0, 900, n), "renewable_mw": 30 + rng.normal(0, 4, n),
        "pred_price_eur_mwh": price + rng.normal(0, 2, n), "pred_demand_kw": 50000 + rng.normal(0, 900, n),
        "pred_renewable_mw": 30 + rng.normal(0, 4, n),
    }
    return made | {c: 10 + rng.normal(0, 3, n) for c in WEATHER_VALUES}


@pytest.mark.parametrize("seed", range(3))
def test_fill_matches_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=160)
    for _ in range(7):
        at, size = rng.integers(0, 150), rng.integers(1, 24)
        x[at : at + size] = np.nan
    index = pd.date_range(START, periods=160, freq="h")
    want = pd.Series(x, index).interpolate(method="time", limit=6).ffill(limit=3).bfill(limit=3)
    got = gaps.interpolate_and_fill(hourly(spark, {"x": x}), ["x"]).orderBy(TS).toPandas()["x"]
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), rtol=1e-9)


def test_pandas_rolling_statistics(spark):
    data = market(120)
    data[PRICE][5:9] = np.nan
    got = signals.signal_frame(hourly(spark, data)).orderBy(TS).toPandas()
    p = pd.Series(data[PRICE])
    vol = p.rolling(24, min_periods=12).std().ffill().fillna(p.expanding(2).std())
    eq = p.rolling(72, min_periods=24).median().ffill().fillna(p.expanding(1).median())
    np.testing.assert_allclose(got["rolling_volatility"].to_numpy(float), vol.to_numpy(), rtol=1e-7)
    np.testing.assert_allclose(got["equilibrium_price_eur_mwh"].to_numpy(float), eq.to_numpy(), rtol=1e-9)
    high = (vol > vol.rolling(72, min_periods=6).quantile(0.7).ffill()).map({True: "high_vol", False: "low_vol"})
    assert got["vol_regime"].tolist() == high.tolist()


def _before(df, k):
    return rows(df.where(F.col(TS) < F.lit(START + dt.timedelta(hours=k))))


@pytest.mark.parametrize("k", [12, 47, 71])
def test_no_lookahead(spark, k):
    a = market(96)
    b = {c: v.copy() for c, v in a.items()}
    for c in b:
        b[c][k:] += 40
    left, right = hourly(spark, a), hourly(spark, b)
    for make in (
        signals.signal_frame,
        baselines.with_baselines,
        lambda d: features.raw_features(quality.fill_optional_context(d)),
    ):
        assert _before(make(left), k) == _before(make(right), k)


def test_signal_contract(spark):
    out = signals.signal_frame(hourly(spark, market(240))).toPandas()
    assert out["target_position"].between(-1, 1).all()
    assert set(out["price_edge_decision"]) <= {"LONG", "SHORT", "HOLD"}
    long = out["pred_price_delta"] > 0.5
    assert (out.loc[long, "price_edge_decision"] == "LONG").all() and (out.loc[long, "target_position"] >= 0).all()


def test_feature_contract(spark):
    df = hourly(spark, {k: v for k, v in market(240).items() if not k.startswith("pred_")})
    shares = quality.require_input(df, [PRICE, "demand_kw"])
    out = features.build_features(df, shares=shares)
    n = out.count()
    assert 0 < n <= 240 - 24
    assert out.na.drop().count() == n
    first = out.first()
    assert first["intraday_price_eur_mwh_available"] == 0.0
    cols = features.model_columns(out)
    assert PRICE not in cols and "series_id" not in cols and f"{PRICE}_lag_24" in cols


def test_input_errors(spark):
    df = hourly(spark, {PRICE: [1.0, None, 3.0]})
    with pytest.raises(ValueError, match="too many missing"):
        quality.require_input(df, [PRICE])
    with pytest.raises(ValueError, match="missing required columns"):
        quality.require_input(df, ["absent"])
    with pytest.raises(ValueError, match="empty"):
        quality.require_input(df.limit(0), [PRICE])
    with pytest.raises(ValueError, match="missing required"):
        signals.signal_frame(df)


def test_keys_do_not_mix(spark):
    one = hourly(spark, market(60, 1), "A")
    two = hourly(spark, market(60, 2), "B")
    both = signals.signal_frame(one.unionByName(two)).where(F.col(KEYS[0]) == "A")
    assert rows(both) == rows(signals.signal_frame(one))
