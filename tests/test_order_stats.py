"""Quantiles and medians by chunk against whole series in pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.config import Chunking
from wattline.functions import chunks, order_stats
from wattline.functions.staging import stage
from wattline.schema import KEYS, TS

START = pd.Timestamp("2024-01-01")


def series(n, kind, seed=1):
    rng = np.random.default_rng(seed)
    x = {
        "smooth": lambda: rng.normal(50, 20, n),
        "ties": lambda: rng.choice([0.0, 5.0, 5.0, 5.0, 7.5], n),
        "wild": lambda: np.exp(rng.normal(0, 12, n)) * rng.choice([-1, 1], n),
        "rising": lambda: np.arange(n, dtype=float),
        "falling": lambda: -np.arange(n, dtype=float),
        "one": lambda: np.full(n, 3.25),
    }[kind]()
    return np.where(rng.random(n) < 0.2, np.nan, x)


KINDS = ["smooth", "ties", "wild", "rising", "falling", "one"]


@pytest.fixture(scope="module")
def frame(spark):
    parts = []
    for i, kind in enumerate(KINDS):
        n = 3000 if i % 2 else 1501
        parts.append(pd.DataFrame({"series_id": kind, TS: START + pd.to_timedelta(np.arange(n), unit="h"), "x": series(n, kind, i)}))
    parts.append(pd.DataFrame({"series_id": "null", TS: [START], "x": [np.nan]}))
    parts.append(pd.DataFrame({"series_id": "single", TS: [START], "x": [4.0]}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return stage(df), pdf


@pytest.mark.parametrize("gather, grid, q", [(order_stats.GATHER, 256, 0.5), (50, 16, 0.7), (50, 256, 0.5), (3, 4, 0.5), (50, 16, 0.0), (50, 16, 1.0)])
def test_quantile_is_exact_however_often_it_is_narrowed(frame, gather, grid, q):
    df, pdf = frame
    got = {r["series_id"]: r["v"] for r in order_stats.quantile(df, KEYS, TS, F.col("x"), q, "v", gather, grid).collect()}
    want = pdf.dropna().groupby("series_id")["x"].quantile(q)
    assert set(got) == set(want.index)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-12), k


def test_narrowing_leaves_few_rows_to_sort(frame, monkeypatch):
    df, pdf = frame
    seen = []
    plain = order_stats._narrow
    monkeypatch.setattr(order_stats, "_narrow", lambda *a: seen.append(plain(*a)) or seen[-1])
    order_stats.quantile(df, KEYS, TS, F.col("x"), 0.5, "v", 50, 64)
    left = {r["series_id"]: r["_in"] for r in seen[-1].collect()}
    assert seen and left["smooth"] <= 150 and left["wild"] <= 150


def test_rolling_quantiles_against_pandas(frame):
    df, pdf = frame
    part = chunks.split(df, TS, back=72, chunking=Chunking(rows=100))
    specs = {"m": ("x", 0.5, 72, 24), "q": ("x", 0.7, 30, 6)}
    got = chunks.core(order_stats.rolling_quantiles(part, chunks.chunk_keys(KEYS), TS, specs)).toPandas().sort_values(["series_id", TS])
    want = pdf.sort_values(["series_id", TS])
    roll = lambda n, k: want.groupby("series_id")["x"].rolling(n, min_periods=k)
    np.testing.assert_allclose(got["m"], roll(72, 24).median().to_numpy(), rtol=1e-12)
    np.testing.assert_allclose(got["q"], roll(30, 6).quantile(0.7).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("rows, grid", [(5000, 256), (100, 4), (7, 16)])
def test_expanding_median_by_chunks(frame, rows, grid):
    df, pdf = frame
    if rows == 7:
        df, pdf = df.where(F.col(TS) < START + pd.Timedelta(hours=200)), pdf[pdf[TS] < START + pd.Timedelta(hours=200)]
    part = stage(chunks.core(chunks.split(df, TS, chunking=Chunking(rows=rows)), keep_chunk=True))
    got = order_stats.expanding_median(part, KEYS, TS, "x", "m", grid).toPandas().sort_values(["series_id", TS])
    want = pdf.sort_values(["series_id", TS]).groupby("series_id")["x"].expanding(1).median()
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["m"].astype(float), want.to_numpy(), rtol=1e-12)


def test_what_reaches_a_chunk_does_not_grow_with_the_series(frame):
    df, _ = frame
    part = chunks.core(chunks.split(df.where("series_id = 'smooth'"), TS, chunking=Chunking(rows=50)), keep_chunk=True)
    own = stage(part.select("series_id", chunks.CHUNK, F.col("x").alias("_x")))
    sizes = order_stats._earlier(own, ["series_id"], ["series_id", chunks.CHUNK], 64).select(F.size(F.flatten("values")).alias("n")).toPandas()
    assert len(sizes) > 25 and sizes["n"].max() <= 50 + 2 * 1501 / 64 + 10
