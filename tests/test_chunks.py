"""Cutting a series into short chunks changes nothing."""

import pytest
from pyspark.sql import Window, functions as F

from conftest import SF, rows
from wattline.config import BacktestConfig, Chunking, SignalConfig
from wattline.functions import chunks
from wattline.functions.staging import stage
from wattline.operators import accuracy, backtest, baselines, compare, features, folds, gaps, quality, review, signals
from wattline.plans import base
from wattline.schema import KEYS, PRICE, TS

SHORT = Chunking(rows=37)


@pytest.fixture(scope="module")
def aligned(spark):
    return stage(base.aligned(spark, SF))


@pytest.fixture(scope="module")
def scored(spark):
    return stage(base.scored(spark, SF))


def test_fill(aligned):
    cols = list(base.PANEL_VALUES)
    assert rows(gaps.interpolate_and_fill(aligned, cols, chunking=SHORT)) == rows(gaps.interpolate_and_fill(aligned, cols))


@pytest.mark.parametrize("force", [False, True])
def test_missing_ranges_do_not_break_at_cuts(aligned, force):
    df = aligned.withColumn("data_quality", F.when(F.col(PRICE).isNotNull(), F.lit("real")))
    want = rows(gaps.missing_ranges(df, [PRICE], force=force))
    for size in (1, 2, 37):
        assert rows(gaps.missing_ranges(df, [PRICE], force=force, chunking=Chunking(rows=size))) == want


def test_carry_against_whole_series(aligned):
    from pyspark.sql import Window

    part = chunks.core(chunks.split(aligned, TS, chunking=SHORT), keep_chunk=True)
    p = F.col(PRICE)
    got = chunks.carry(part, KEYS, TS, fills={"f": p}, moments={"m": p}, sums={"s": p}, maxes={"x": p})
    w = Window.partitionBy(*KEYS).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    want = aligned.select(
        *KEYS, TS, F.last(p, True).over(w).alias("f"), F.avg(p).over(w).alias("m_mean"),
        F.stddev_samp(p).over(w).alias("m_std"), F.coalesce(F.sum(p).over(w), F.lit(0.0)).alias("s"), F.max(p).over(w).alias("x"),
    )
    assert rows(got.select(*want.columns)) == rows(want)


def test_row_numbers(aligned):
    from pyspark.sql import Window

    got = chunks.number_rows(aligned.select(*KEYS, TS), KEYS, TS, chunking=SHORT)
    want = aligned.select(*KEYS, TS, (F.row_number().over(Window.partitionBy(*KEYS).orderBy(TS)) - 1).alias(chunks.ROW))
    assert rows(got) == rows(want)


def test_signals(scored):
    names = [*KEYS, TS, "rolling_volatility", "equilibrium_price_eur_mwh", "vol_regime", "market_regime", "target_position"]
    short = signals.signal_frame(scored, chunking=SHORT).select(*names)
    assert rows(short) == rows(signals.signal_frame(scored).select(*names))


def test_baselines(scored):
    assert rows(baselines.with_baselines(scored, chunking=SHORT), 5) == rows(baselines.with_baselines(scored), 5)


@pytest.mark.parametrize("delay", [True, False])
def test_backtest(scored, delay):
    cfg = BacktestConfig(execution_delay=delay)
    names = [*KEYS, TS, "position", "turnover", "net_pnl_eur", "equity_eur", "strategy_return", "decision", "accuracy_status"]
    short = backtest.backtest(scored, cfg, chunking=SHORT, keep_chunk=True)
    whole = backtest.backtest(scored, cfg, keep_chunk=True)
    assert rows(short.select(*names), 5) == rows(whole.select(*names), 5)
    assert rows(backtest.metrics(short, cfg), 5) == rows(backtest.metrics(whole, cfg), 5)


def test_equity_at_its_bounds(spark, scored):
    df = scored.select(*KEYS, TS, (F.col(PRICE) - 60).alias("net_pnl_eur"))
    short = folds.equity_curve(chunks.core(chunks.split(df, TS, chunking=SHORT), True), "net_pnl_eur", 50.0)
    whole = folds.equity_curve(chunks.core(chunks.split(df, TS), True), "net_pnl_eur", 50.0)
    names = [*KEYS, TS, "equity_eur", "strategy_return"]
    assert rows(short.select(*names), 5) == rows(whole.select(*names), 5)


def test_drawdown_runs_cross_cuts(spark, scored):
    df = scored.select(*KEYS, TS, (1.0 - F.row_number().over(backtest.Window.partitionBy(*KEYS).orderBy(TS)) / 1e4).alias("equity_curve"))
    short = chunks.core(chunks.split(df, TS, chunking=SHORT), True)
    got = {r.series_id: r.drawdown_duration_steps for r in backtest.drawdowns(short).collect()}
    want = {r.series_id: r.n - 1 for r in df.groupBy(*KEYS).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_features(spark):
    df = stage(base.merged(spark, SF))
    short = features.raw_features(quality.fill_optional_context(df), chunking=SHORT)
    whole = features.raw_features(quality.fill_optional_context(df))
    assert rows(short, 6) == rows(whole, 6)


def test_accuracy_and_rolling(scored):
    df = scored.withColumns({"decision": F.lit("LONG"), "pnl": F.col(PRICE) - 50})
    short = accuracy.decision_accuracy(df, 24, chunking=SHORT)
    whole = accuracy.decision_accuracy(df, 24)
    assert rows(short) == rows(whole)
    assert rows(review.rolling_accuracy(short, chunking=SHORT)) == rows(review.rolling_accuracy(whole))


def test_strategies_share_one_market_pass(scored):
    """Each strategy of the joint run equals its own single run."""
    joint = stage(compare.strategy_rows(scored))
    names = [*KEYS, TS, "position", "net_pnl_eur", "equity_eur", "decision"]
    for new, name in ((True, "upgraded_strategy"), (False, "original_strategy")):
        alone = backtest.backtest(scored, BacktestConfig(signal=SignalConfig(new_signal=new)))
        part = joint.where(F.col("strategy_name") == name)
        assert rows(part.select(*names), 5) == rows(alone.select(*names), 5)


def test_a_series_is_many_tasks(spark):
    """With short chunks the rows of one series lie in several partitions after gap repair."""
    start = F.to_timestamp(F.lit("2024-01-01"))
    rows = spark.range(2000).select(F.lit("Z0").alias("series_id"), F.timestamp_seconds(F.unix_timestamp(start) + F.col("id") * 3600).alias(TS), F.col("id").cast("double").alias("x"))
    part = chunks.split(rows, TS, back=3, chunking=Chunking(rows=48))
    w = Window.partitionBy(*chunks.chunk_keys(KEYS)).orderBy(TS)
    out = chunks.core(part.withColumn("m", F.avg("x").over(w.rowsBetween(-3, 0))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny here
    try:
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert out.count() == 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
