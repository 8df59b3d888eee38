"""The bootstrap by blocks: the same draws in plain Python, and their distribution."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.functions import chunks
from wattline.operators import significance
from wattline.schema import KEYS, TS


def wide(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    parts = [
        pd.DataFrame({"series_id": k, TS: pd.date_range("2024-01-01", periods=n, freq="h"), chunks.ROW: np.arange(n), "a": rng.normal(1e6, 1, n), "b": 0.25})
        for k, n in lengths.items()
    ]
    pdf = pd.concat(parts, ignore_index=True)
    return spark.createDataFrame(pdf), pdf


def number(*parts):
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def picks(n, block, rep, seed=42):
    split = Counter(number(seed, rep, "block", j) % n // block for j in range(n)) if n > block else {0: n}
    return [b * block + number(seed, rep, b, k) % min(block, n - b * block) for b, w in split.items() for k in range(w)]


def sharpe(x):
    std = x.std(ddof=1)
    return x.mean() / std * np.sqrt(24) if std > 0 else 0.0


@pytest.mark.parametrize("block", [1000, 40, 7])
def test_replicates_agree_with_plain_draws(spark, block):
    df, pdf = wide(spark, {"s": 100, "t": 41, "u": 2})
    got = significance.bootstrap(df, ["a", "b"], iterations=20, block=block).collect()
    assert len(got) == 60
    for r in got:
        x = pdf[pdf["series_id"] == r["series_id"]]["a"].to_numpy()
        drawn = x[picks(len(x), block, r["replicate"])]
        assert r["mean__a"] == pytest.approx(drawn.mean(), rel=1e-12)
        assert r["sharpe__a"] == pytest.approx(sharpe(drawn), rel=1e-6, abs=1e-6)
        assert r["sharpe__b"] == 0.0 and r["mean__b"] == 0.25


def test_draws_over_blocks_are_uniform_and_independent():
    n, block, reps = 60, 25, 4000
    counts = np.array([np.bincount(picks(n, block, rep), minlength=n) for rep in range(reps)])
    assert (counts.sum(axis=1) == n).all()
    # Each row is drawn once on average with variance 1 - 1/n; two rows have covariance -1/n, in one block or two.
    assert abs(counts.mean(axis=0) - 1).max() < 5 / np.sqrt(reps)
    assert counts.var(axis=0).mean() == pytest.approx(1 - 1 / n, abs=0.02)
    cov = np.cov(counts.T)
    same = cov[:25, :25][~np.eye(25, dtype=bool)].mean()
    assert same == pytest.approx(-1 / n, abs=0.003) and cov[:25, 25:50].mean() == pytest.approx(-1 / n, abs=0.003)
    # The number of draws in the short last block is binomial.
    last = counts[:, 50:].sum(axis=1)
    assert last.mean() == pytest.approx(10, abs=0.25) and last.var() == pytest.approx(60 * (1 / 6) * (5 / 6), rel=0.1)


def test_weighted_replicates_keep_small_deviations(spark):
    """Squares of values around a million would cancel; around the centre they do not."""
    df, pdf = wide(spark, {"s": 400})
    got = significance.bootstrap(df, ["a", "b"], iterations=60, method="poisson").toPandas()
    x = pdf["a"].to_numpy()
    assert got["sharpe__a"].median() == pytest.approx(sharpe(x), rel=0.05)
    assert (got["sharpe__b"] == 0).all()
