"""Refresh scenarios, validated writes, the run index and streams."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from wattline.config import ForecastConfig
from wattline.operators import forecast, joins, quality, review
from wattline.plans import base, workflow
from wattline.plans.catalog import QUERIES
from wattline.schema import DAY_AHEAD, DEMAND, ENERGY_SCHEMA, PRICE, QUALITY, RENEWABLE, TS, conform
from wattline.sources import feeds, storage

VALUES = (PRICE, DAY_AHEAD, DEMAND, RENEWABLE)
DAY = "2024-03-01"
AT = dt.datetime(2024, 3, 2)


def day(spark, hours, value=10.0, minutes=(0,)):
    data = [("A", dt.datetime(2024, 3, 1, h, m), *[value + h] * 4) for h in hours for m in minutes]
    return spark.createDataFrame(data, f"series_id string, {TS} timestamp, " + ", ".join(f"{c} double" for c in VALUES))


def refresh(spark, existing, source, force=False):
    asked = []

    def fetch(ranges):
        asked.extend((str(r.range_start), str(r.range_end)) for r in ranges.orderBy("range_start").collect())
        return source

    series = spark.createDataFrame([("A",)], "series_id string")
    out = workflow.refresh_panel(
        existing, series, f"{DAY} 00:00:00", f"{DAY} 11:00:00", fetch, "feed", F.lit(AT), VALUES, VALUES, force=force
    )
    return out, asked


def test_only_the_tail_is_fetched(spark):
    old = quality.annotate_source(day(spark, range(8)), VALUES, "feed", F.lit(AT))
    out, asked = refresh(spark, old, day(spark, range(8, 12), minutes=(0, 15, 30, 45)))
    assert asked == [(f"{DAY} 08:00:00", f"{DAY} 12:00:00")]
    summary = out.provenance.first()
    assert (summary.row_count, summary.real_rows, summary.research_grade) == (12, 12, True)
    assert out.diagnostics.first().fetched_rows == 4


def test_failed_fetch_is_overlaid_and_labelled(spark):
    old = quality.annotate_source(day(spark, range(8)), VALUES, "feed", F.lit(AT))
    out, _ = refresh(spark, old, day(spark, []))
    panel = {r[TS].hour: r for r in out.panel.collect()}
    assert panel[9][QUALITY] == "synthetic" and panel[9]["data_source"] == "feed_synthetic"
    assert panel[9][PRICE] is not None and panel[3][QUALITY] == "real"


def test_force_refetches_everything_and_keeps_the_outside(spark):
    old = quality.annotate_source(day(spark, range(15)), VALUES, "feed", F.lit(AT))
    out, asked = refresh(spark, old, day(spark, range(12), 50.0), force=True)
    assert asked == [(f"{DAY} 00:00:00", f"{DAY} 12:00:00")]
    panel = {r[TS].hour: r for r in out.panel.collect()}
    assert panel[2][PRICE] == 52.0 and panel[13][PRICE] == 23.0 and len(panel) == 15


def test_real_replaces_synthetic(spark):
    low = day(spark, range(3), 1.0).withColumns({QUALITY: F.lit("synthetic"), "fetch_timestamp_utc": F.lit(AT)})
    high = day(spark, range(3), 5.0).withColumns({QUALITY: F.lit("real"), "fetch_timestamp_utc": F.lit(None).cast("timestamp")})
    out = quality.upsert_by_quality(low.unionByName(high))
    assert {r[PRICE] for r in out.collect()} == {5.0, 6.0, 7.0}


def test_failed_validation_keeps_old_files(spark):
    path = tempfile.mkdtemp(prefix="panel-")
    rules = quality.PanelRules(required=(PRICE,))
    good = conform(day(spark, range(4)), ENERGY_SCHEMA)
    storage.write_panel(good, path, "energy", rules)
    with pytest.raises(ValueError, match="null_required"):
        storage.write_panel(good.withColumn(PRICE, F.lit(None).cast("double")), path, "energy", rules)
    with pytest.raises(ValueError, match="duplicate_timestamp"):
        storage.write_panel(good.unionByName(good), path, "energy", rules)
    back = storage.read_panel(spark, path, ENERGY_SCHEMA)
    assert rows(back) == rows(good)


def test_run_index_appends_and_masks(spark):
    path = tempfile.mkdtemp(prefix="runs-") + "/index"
    run = {"run_id": "r1", "model": "additive", "config_snapshot": {"api_key": "abc", "hf_token": "", "seed": 1}, "metrics": {"sharpe_ratio": 1}}
    storage.append_run_index(spark, run, path)
    out = storage.append_run_index(spark, {**run, "run_id": "r2"}, path)
    assert out.count() == 2
    snapshot = out.first().config_snapshot
    assert snapshot["api_key"] == "***set***" and snapshot["hf_token"] is None and snapshot["seed"] == "1"


def test_run_artifacts_must_be_complete(spark):
    root = tempfile.mkdtemp(prefix="run-")
    scored = base.scored(spark, SF)
    storage.write_results(scored, f"{root}/results")
    storage.write_metrics(scored.agg(F.avg(PRICE).alias("m")), f"{root}/metrics")
    with pytest.raises(FileNotFoundError, match="analytics"):
        storage.load_run_artifacts(spark, root)
    storage.write_metrics(scored.agg(F.struct(F.avg(PRICE).alias("m")).alias("a")), f"{root}/analytics")
    results, metrics, analytics = storage.load_run_artifacts(spark, root)
    assert results.count() == scored.count() and metrics.count() == analytics.count() == 1


def test_feed_shapes(spark):
    one = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 5.0)], "series_id string, t timestamp, v double")
    assert feeds.normalise_feed(one, "demand_mw", "t").columns == ["series_id", TS, "demand_mw"]
    single = one.withColumnRenamed("t", TS)
    row = feeds.split_two_sided_price(single).first()
    assert row.imbalance_price_buy_eur_mwh == row.imbalance_price_sell_eur_mwh == row.imbalance_price_eur_mwh == 5.0


def test_dates_cover_the_last_day(spark):
    df = day(spark, [0, 23])
    assert review.filter_dates(df, DAY, DAY).count() == 2
    assert review.filter_dates(df, DAY, f"{DAY} 12:00:00").count() == 1


def test_folds(spark):
    sizes = spark.createDataFrame([("A", 480), ("B", 20 * 24 - 1), ("C", 168)], "series_id string, rows long")
    fc = ForecastConfig(train_days=10, test_days=5)
    folds = forecast.walk_forward_folds(sizes, fc).orderBy("series_id", "fold").collect()
    assert [(r.series_id, r.train_start, r.test_start, r.test_end) for r in folds] == [
        ("A", 0, 240, 360), ("A", 120, 360, 480), ("B", 0, 240, 360), ("C", 0, 48, 168),
    ]
    with pytest.raises(ValueError, match="not enough rows"):
        forecast.require_folds(forecast.walk_forward_folds(sizes.where("rows = 1"), fc), fc)
    with pytest.raises(ValueError, match="positive"):
        forecast.walk_forward_folds(sizes, ForecastConfig(train_days=0))
    with pytest.raises(ValueError):
        forecast.adjust_train_days(100, fc)
    assert forecast.adjust_train_days(300, fc).train_days == 7


def test_additive_equals_plain_ridge(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    n = 24 * 12
    x = rng.normal(size=n)
    y = 3 * x + np.arange(n) * 0.01 + 5
    data = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(data, f"series_id string, {TS} timestamp, x double, y double")
    fc = ForecastConfig(train_days=5, test_days=2)
    scored, coefs = forecast.fit_additive(df, ["x"], fc, {"p": "y"}, knots=0, daily=1, weekly=0, ridge=1e-9)
    assert scored.count() == 6 * 24
    worst = scored.agg(F.max(F.abs(F.col("p") - F.col("y")))).first()[0]
    assert worst < 1e-3
    effects = [r.effect for r in coefs.where("term = 'x'").collect()]
    assert len(effects) == 3 and all(abs(e - 3) < 1e-4 for e in effects)


def test_pruning_keeps_the_earlier_feature(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, d = rng.normal(size=200), rng.normal(size=200)
    data = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(a[i]), float(2 * a[i]), 1.0, float(d[i])) for i in range(200)]
    df = spark.createDataFrame(data, f"series_id string, {TS} timestamp, a double, b double, c double, d double")
    fc = ForecastConfig(train_days=5, test_days=1)
    pruned = forecast.prune_features(df, ["a", "b", "c", "d"], fc, pooled=True)
    assert forecast.kept_features(pruned) == ["a", "d"]
    assert forecast.kept_features(forecast.prune_features(df, ["c"], fc, pooled=True)) == ["c"]


def test_fallback_decision_against_numpy(spark):
    import numpy as np

    from test_fills_and_causality import hourly, market
    from wattline.operators import decision

    m = market(80)
    got = decision.fallback_decision(hourly(spark, m)).first()
    p = m[PRICE]
    imb, chg = m["pred_demand_kw"] / 1000 - m["pred_renewable_mw"], m["pred_price_eur_mwh"] - p
    z = lambda v: (v - v.mean()) / v.std(ddof=1)
    y = (p[1:] - p[:-1]) / np.maximum(np.abs(p[:-1]), 1)
    x = np.column_stack([np.ones(80), z(imb), z(chg)])
    w = np.linalg.lstsq(x[:-1], y, rcond=None)[0]
    assert abs(got.score - x[-1] @ w) < 1e-9
    few = decision.fallback_decision(hourly(spark, market(3))).first()
    assert few.position == 0.0 and few.decision == "HOLD"


def test_pairs_are_cut_to_the_shorter(spark):
    a = day(spark, range(6)).withColumnRenamed(PRICE, "strategy_return")
    b = day(spark, range(4)).withColumnRenamed(PRICE, "strategy_return")
    assert joins.pair_streams(a, b).count() == 4


@pytest.mark.parametrize("pair", [("streaming_upsert", "upsert_by_quality"), ("streaming_decision_log", "decision_log_json")])
def test_streams_agree_with_batch(spark, pair):
    stream, batch = QUERIES[pair[0]](spark, SF), QUERIES[pair[1]](spark, SF)
    assert rows(stream) == rows(batch.select(*stream.columns))


def test_streaming_position_state(spark):
    got = QUERIES["streaming_ramp"](spark, SF)
    want = QUERIES["position_ramp"](spark, SF)
    a = got.select("series_id", TS, F.col("position_after").alias("p"))
    b = want.select("series_id", TS, F.col("target_position_constrained").alias("p"))
    assert rows(a) == rows(b)


def test_bootstrap_properties(spark):
    import numpy as np

    from wattline.operators import significance

    rng = np.random.default_rng(5)
    data = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(rng.normal(0.01, 0.1, 300))]
    df = spark.createDataFrame(data, f"series_id string, {TS} timestamp, strategy_return double")
    for method in ("iid", "poisson"):
        one = significance.bootstrap_sharpe(df, iterations=60, method=method).first()
        assert one.ci_lower <= one.sharpe <= one.ci_upper
        assert one == significance.bootstrap_sharpe(df, iterations=60, method=method).first()
    same = significance.compare_streams(df, df, iterations=30).first()
    assert same.sharpe_diff == 0.0 and not same.significant_outperformance
    better = df.withColumn("strategy_return", F.col("strategy_return") + 1.0)
    assert significance.compare_streams(better, df, iterations=30).first().significant_outperformance
