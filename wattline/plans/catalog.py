"""One query per operator, over the whole given tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import BacktestConfig, ForecastConfig, SignalConfig
from ..functions import chunks
from ..functions.staging import scratch, stage
from ..functions.windows import ordered, pct_change
from ..operators import (
    backtest, baselines, compare, decision, diagnostics, features, folds, forecast, gaps, joins, quality,
    recurrent, review, signals, significance,
)
from ..schema import (
    DAY_AHEAD, DEMAND, ENERGY_SCHEMA, FEATURE_REQUIRED, FETCHED, IMBALANCE, INTRADAY, IS_SYNTHETIC, KEYS, PRED_PRICE,
    PRICE, QUALITY, RENEWABLE, SOURCE, SPREAD, TS, VERSION, WEATHER_VALUES, conform,
)
from ..sources import feeds, ranges, storage
from ..sources.versions import VersionedPanel
from ..streaming import flows
from . import base, workflow
from .base import PANEL_VALUES, present

QUERIES: dict = {}
REQUIRED = (PRICE, DAY_AHEAD, DEMAND, RENEWABLE)
START, MIDDLE, SPLIT, END = "2024-01-01 00:00:00", "2024-01-15 00:00:00", "2024-01-20 00:00:00", "2024-01-30 23:00:00"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- grid, gaps, rollup


@query
def hourly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.events(spark, sf).withColumnRenamed("ts", TS)
    return present(gaps.rollup_hourly(rows, ["value"]))


@query
def hourly_rollup_no_values(spark, sf):
    return present(gaps.rollup_hourly(base.events(spark, sf).withColumnRenamed("ts", TS), []))


@query
def quarter_hour_rollup(spark, sf):
    """A 15-minute feed first, then its hourly mean."""
    rows = base.events(spark, sf)
    quarter = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900).alias(TS)
    feed = rows.groupBy(*KEYS, quarter).agg(base.six(F.avg("value")).alias("value"))
    return present(gaps.rollup_hourly(feed, ["value"]))


@query
def hourly_grid_coverage(spark, sf):
    rows = base.panel(spark, sf)
    grid = gaps.hourly_grid(gaps.series_bounds(rows))
    full = gaps.align_to_grid(grid, rows.withColumn("_present", F.lit(True)))
    return full.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("grid_rows"), F.count("_present").alias("present_rows"))


@query
def missing_ranges(spark, sf):
    rows = base.aligned(spark, sf).withColumn(QUALITY, F.when(F.col(PRICE).isNotNull(), F.lit("real")))
    return present(gaps.missing_ranges(rows, [PRICE]))


@query
def missing_ranges_forced(spark, sf):
    rows = base.aligned(spark, sf).withColumn(QUALITY, F.lit("real"))
    return present(gaps.missing_ranges(rows, [PRICE], force=True))


@query
def chunked_ranges(spark, sf):
    spans = gaps.series_bounds(base.panel(spark, sf)).withColumnsRenamed({"start": "range_start", "end": "range_end"})
    return present(gaps.chunk_ranges(spans, 7))


@query
def bisected_ranges(spark, sf):
    spans = gaps.series_bounds(base.panel(spark, sf)).withColumnsRenamed({"start": "range_start", "end": "range_end"})
    return present(gaps.bisect_ranges(gaps.bisect_ranges(spans)))


@query
def interpolate_and_fill(spark, sf):
    return present(gaps.interpolate_and_fill(base.aligned(spark, sf), list(PANEL_VALUES)))


@query
def causal_fill(spark, sf):
    return present(gaps.interpolate_and_fill(base.aligned(spark, sf), list(PANEL_VALUES), causal=True))


@query
def resolved_prices(spark, sf):
    rows = base.aligned(spark, sf).withColumn(INTRADAY, F.lit(None).cast("double"))
    return present(gaps.resolve_prices(rows).select(*KEYS, TS, PRICE, DAY_AHEAD, INTRADAY, SPREAD))


# ---------------------------------------------------------------- quality and provenance


@query
def repaired_quality(spark, sf):
    rows = base.aligned(spark, sf)
    rows = quality.annotate_source(rows, [PRICE], "feed", F.lit("2024-02-01").cast("timestamp"))
    filled = gaps.interpolate_and_fill(rows, list(PANEL_VALUES))
    return present(gaps.mark_repaired(filled).select(*KEYS, TS, PRICE, QUALITY, IS_SYNTHETIC, SOURCE, "had_gap"))


@query
def repaired_flags(spark, sf):
    rows = quality.repaired_flags(base.aligned(spark, sf), REQUIRED, [IMBALANCE])
    return rows.groupBy(*KEYS, "required_repaired", "optional_repaired").agg(F.count(F.lit(1)).alias("n"))


@query
def annotated_source(spark, sf):
    rows = quality.annotate_source(base.panel(spark, sf), REQUIRED, "feed", F.lit("2024-02-01").cast("timestamp"))
    return present(rows.select(*KEYS, TS, QUALITY, IS_SYNTHETIC, SOURCE, FETCHED, VERSION))


@query
def upsert_by_quality(spark, sf):
    return present(quality.upsert_by_quality(base.candidates(spark, sf), tie_break=["event_id"]))


@query
def incremental_merge(spark, sf):
    rows = base.candidates(spark, sf)
    old = quality.upsert_by_quality(rows.where(F.col(TS) < F.lit(SPLIT).cast("timestamp")), tie_break=["event_id"])
    new = rows.where(F.col(TS) >= F.lit(MIDDLE).cast("timestamp"))
    return present(quality.incremental_merge(old, new, MIDDLE, END, tie_break=["event_id"]))


@query
def dedupe_first(spark, sf):
    rows = base.candidates(spark, sf).select(*KEYS, TS, PRICE, "event_id")
    return present(quality.dedupe_first(rows, ["event_id"]))


def _overlaid(spark, sf):
    rows = base.aligned(spark, sf)
    rows = rows.withColumns(
        {
            QUALITY: F.when(F.col(PRICE).isNotNull(), F.lit("real")),
            SOURCE: F.when(F.col(PRICE).isNotNull(), F.lit("feed")),
            FETCHED: F.lit(None).cast("timestamp"),
        }
    )
    rows = stage(rows)
    side = workflow.seasonal_fallback(rows, PANEL_VALUES)
    at = F.lit("2024-02-01").cast("timestamp")
    return quality.fill_from_fallback(rows, side, PANEL_VALUES, REQUIRED, "feed_synthetic", at)


@query
def fallback_overlay(spark, sf):
    return present(_overlaid(spark, sf))


@query
def provenance_summary(spark, sf):
    return present(quality.classify_mode(quality.provenance_summary(base.candidates(spark, sf)), "feed"))


@query
def refresh_diagnostics(spark, sf):
    """Existing rows up to the 20th, new rows from the 15th, the rest by the seasonal profile."""
    rows = base.panel(spark, sf)
    at = F.lit("2024-02-01").cast("timestamp")
    old = quality.annotate_source(rows.where(F.col(TS) < F.lit(SPLIT).cast("timestamp")), REQUIRED, "feed", at)
    new = rows.where(F.col(TS) >= F.lit(MIDDLE).cast("timestamp"))

    def fetch(ranges):
        # The feed answers with the rows of the missing ranges only: an equi-join on their hours.
        hours = gaps.hourly_grid(
            ranges.withColumn("end", F.col("range_end") - F.expr("INTERVAL 1 HOUR")), "range_start", "end"
        )
        return new.join(hours, [*KEYS, TS], "left_semi")

    out = workflow.refresh_panel(old, rows, MIDDLE, END, fetch, "feed", at, PANEL_VALUES, REQUIRED)
    return present(out.diagnostics)


@query
def validation_report(spark, sf):
    rows = base.candidates(spark, sf).withColumn("zone", F.col("series_id"))
    rules = quality.PanelRules(
        required=(FETCHED,), version=1, zone_equals=F.lit("Z1"), start=START, end=END
    )
    return quality.validate_panel(rows, rules)


@query
def coerced_types(spark, sf):
    """JSON text as loose input: numbers read, everything else NULL."""
    rows = base.events(spark, sf).select(
        *KEYS,
        F.col("ts").cast("string").alias(TS),
        F.get_json_object("props", "$.k").alias("good"),
        F.col("props").alias("bad"),
        "event_id",
    )
    out = quality.coerce_types(rows, ["good", "bad", "absent"], text=())
    return out.groupBy(*KEYS).agg(
        F.count(TS).alias("times"), F.count("good").alias("good"), F.count("bad").alias("bad"),
        F.count("absent").alias("absent"), F.sum("good").alias("good_sum"),
    )


@query
def conformed_schema(spark, sf):
    out = conform(base.panel(spark, sf), ENERGY_SCHEMA)
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count(PRICE).alias("prices"), F.count(INTRADAY).alias("intraday"),
        F.count_if(IS_SYNTHETIC).alias("synthetic"), F.sum(VERSION).alias("versions"),
    )


@query
def input_null_shares(spark, sf):
    return present(quality.null_shares(base.aligned(spark, sf), [*PANEL_VALUES, INTRADAY]))


@query
def optional_context(spark, sf):
    rows = base.aligned(spark, sf)
    return present(quality.fill_optional_context(rows))


@query
def anomaly_report(spark, sf):
    return present(quality.anomaly_report(base.clean(spark, sf), [PRICE, DEMAND, RENEWABLE, SPREAD]))


@query
def anomaly_summary(spark, sf):
    report = quality.anomaly_report(base.clean(spark, sf), [PRICE, DEMAND, RENEWABLE, SPREAD])
    return quality.anomaly_summary(report)


@query
def frame_stats(spark, sf):
    return present(quality.frame_stats(base.panel(spark, sf)))


# ---------------------------------------------------------------- joins and feeds


@query
def energy_weather_join(spark, sf):
    return present(base.merged(spark, sf).select(*KEYS, TS, PRICE, DEMAND, RENEWABLE, *WEATHER_VALUES))


def _kind(spark, sf, kind, name):
    rows = base.events(spark, sf).where(F.col("event_type") == kind).withColumnRenamed("ts", TS)
    return gaps.rollup_hourly(rows.withColumn(name, F.col("value")), [name])


@query
def feed_outer_join(spark, sf):
    main = joins.join_feeds(
        [_kind(spark, sf, "signup", DAY_AHEAD), _kind(spark, sf, "view", "demand_mw"), _kind(spark, sf, "click", RENEWABLE)]
    )
    full = joins.join_optional(main, [_kind(spark, sf, "purchase", INTRADAY), _kind(spark, sf, "error", IMBALANCE)])
    return present(joins.derive_market_columns(full))


@query
def reindexed_fallback(spark, sf):
    prices = _kind(spark, sf, "purchase", PRICE)
    return present(joins.reindex_like(_kind(spark, sf, "signup", DAY_AHEAD), prices))


@query
def rows_in_time_set(spark, sf):
    return present(joins.filter_isin(base.panel(spark, sf), _kind(spark, sf, "error", IMBALANCE)))


@query
def paired_streams(spark, sf):
    a = _kind(spark, sf, "purchase", "strategy_return")
    b = _kind(spark, sf, "signup", "strategy_return")
    return present(joins.pair_streams(a, b).drop(TS))


@query
def wide_feed(spark, sf):
    rows = base.panel(spark, sf)
    total = feeds.wide_feed_to_column(rows, "sum", "generation", [PRICE, RENEWABLE, IMBALANCE])
    mean = feeds.wide_feed_to_column(rows, "mean", "session", [PRICE, DAY_AHEAD])
    return present(total.join(mean, [*KEYS, TS]))


@query
def two_sided_price(spark, sf):
    rows = base.panel(spark, sf).select(*KEYS, TS, F.col(PRICE).alias("Long"), F.col(IMBALANCE).alias("Short"))
    return present(feeds.split_two_sided_price(rows))


@query
def normalised_feed(spark, sf):
    rows = base.events(spark, sf).select(
        *KEYS, "ts", F.struct(F.col("value").alias("actual"), F.col("user_id").alias("unit")).alias("load")
    )
    out = feeds.normalise_feed(rows, "demand_mw", "ts")
    return out.groupBy(*KEYS).agg(
        F.round(F.sum("load actual"), 3).alias("actual"), F.sum("load unit").alias("unit"), F.count(TS).alias("n")
    )


def _payloads(spark, sf):
    rows = base.weather(spark, sf)
    day = F.date_trunc("day", TS).alias("day")
    hours = F.array_sort(
        F.collect_list(F.struct(TS, *[F.col(c) for c in WEATHER_VALUES]))
    )
    packed = rows.groupBy(*KEYS, day).agg(hours.alias("h"))
    source = dict(zip(feeds.HOURLY_NAMES, [TS, *WEATHER_VALUES]))
    payload = packed.select(
        *KEYS,
        F.struct(
            *[
                (F.col(f"h.{c}").cast("array<string>") if n == "time" else F.col(f"h.{c}")).alias(n)
                for n, c in source.items()
            ]
        ).alias("hourly"),
    )
    return payload


@query
def hourly_arrays(spark, sf):
    """One payload of parallel arrays per series and day, exploded back to rows."""
    return present(feeds.explode_hourly(_payloads(spark, sf)))


@query
def hourly_array_files(spark, sf):
    """The same payloads as JSON files, read with the fixed schema."""
    path = scratch(spark, "payloads")
    _payloads(spark, sf).write.json(path)
    return present(storage.read_hourly_arrays(spark, path))


# ---------------------------------------------------------------- features


@query
def calendar_features(spark, sf):
    return present(features.calendar(base.panel(spark, sf).select(*KEYS, TS)), 6)


@query
def lag_roll_features(spark, sf):
    part = chunks.split(features.derived_levels(_with_context(spark, sf)), TS, back=24)
    out = chunks.core(features.lag_roll(part, (PRICE, "net_load_mw"), chunks.chunk_keys(KEYS)))
    names = [c for c in out.columns if "_lag_" in c or "_roll_" in c or "_ramp_" in c]
    return present(out.select(*KEYS, TS, *names))


def _with_context(spark, sf):
    return quality.fill_optional_context(base.merged(spark, sf))


@query
def regime_features(spark, sf):
    out = features.raw_features(_with_context(spark, sf))
    names = [
        "price_momentum", "imbalance_zscore_24", "realized_volatility_24", "spread_volatility_24", "high_vol_regime",
        "intraday_stress_proxy", "winter_peak_interaction", "solar_shape_proxy", "wind_ramp_proxy",
        "temperature_c_anomaly", "humidity_pct_anomaly", "net_load_mw_x_hour_sin", f"{SPREAD}_x_dow_cos",
        "renewable_penetration",
    ]
    return present(out.select(*KEYS, TS, *names))


@query
def feature_matrix(spark, sf):
    """Finished features per series: row count, first hour and a checksum over all columns."""
    out = features.build_features(base.merged(spark, sf), drop_empty_columns=False)
    numeric = features.model_columns(out)
    total = sum((F.col(c).cast("double") for c in numeric[1:]), F.col(numeric[0]).cast("double"))
    return present(
        out.groupBy(*KEYS).agg(
            F.count(F.lit(1)).alias("n"), F.min(TS).alias("first_ts"), F.lit(len(numeric)).alias("features"),
            F.avg("price_eur_mwh_roll_std_24").alias("roll_std"), F.sum("high_vol_regime").alias("high_vol_rows"),
            F.avg(total).alias("row_total"),
        )
    )


@query
def nonempty_columns(spark, sf):
    """A column without any value leaves, all others stay."""
    rows = base.aligned(spark, sf).withColumn(INTRADAY, F.lit(None).cast("double"))
    return present(features.drop_all_null(stage(rows)))


@query
def dense_windows(spark, sf):
    """Row windows on the long daily panel, whose rows are numbered because its grid has other steps."""
    rows = chunks.number_rows(base.dense(spark, sf), KEYS, TS)
    part = chunks.split(rows, TS, back=24, index=chunks.ROW)
    w = ordered(chunks.chunk_keys(KEYS), TS)
    part = part.withColumns(
        {
            "mean_24": F.when(F.count(PRICE).over(w.rowsBetween(-23, 0)) >= 24, F.avg(PRICE).over(w.rowsBetween(-23, 0))),
            "change": pct_change(F.col(PRICE), w),
            "step": F.col(DEMAND) - F.lag(DEMAND).over(w),
        }
    )
    out = chunks.core(part).withColumnRenamed(chunks.ROW, "row_number")
    return present(out.select(*KEYS, TS, "row_number", PRICE, "mean_24", "change", "step"))


@query
def horizon_features(spark, sf):
    rows = base.clean(spark, sf).select(*KEYS, TS, PRICE, DEMAND)
    return present(features.shift_for_horizon(rows, [PRICE, DEMAND], 2))


# ---------------------------------------------------------------- signals

SIGNALS = [
    "rolling_volatility", "equilibrium_price_eur_mwh", "forecast_signal", "mean_reversion_signal", "fundamental_signal",
    "spread_signal", "vol_regime", "market_regime", "price_edge_decision", "price_edge_strength", "ensemble_signal",
    "target_position_raw", "target_position",
]


@query
def signal_frame(spark, sf):
    return present(signals.signal_frame(base.scored(spark, sf)).select(*KEYS, TS, *SIGNALS))


@query
def signal_legacy(spark, sf):
    cfg = SignalConfig(new_signal=False)
    return present(signals.signal_frame(base.scored(spark, sf), cfg).select(*KEYS, TS, *SIGNALS))


@query
def baseline_forecasts(spark, sf):
    out = baselines.with_baselines(base.clean(spark, sf).drop("had_gap").withColumns(
        {p: F.lit(None).cast("double") for p in baselines.TARGETS}
    ))
    names = [f"{b}__{p}" for b in baselines.BASELINES for p in baselines.TARGETS]
    return present(out.select(*KEYS, TS, *[F.col(n).alias(n.replace("__", "_")) for n in names]))


# ---------------------------------------------------------------- backtest


def _result(spark, sf, cfg=BacktestConfig(), **options):
    return backtest.backtest(base.scored(spark, sf), cfg, **options)


@query
def position_ramp(spark, sf):
    cols = ["target_position", "target_position_constrained", "liquidity_clipped", "position_clipped", "position", "turnover"]
    return present(_result(spark, sf).select(*KEYS, TS, *cols))


@query
def backtest_costs(spark, sf):
    cols = [
        "reference_price_eur_mwh", "exposure_mwh", "price_change_eur_mwh", "price_return", "forward_price_change_eur_mwh",
        "fill_price_eur_mwh", "spread_cost_eur", "slippage_cost_eur", "delay_cost_eur", "transaction_cost_eur",
        "gross_pnl_eur", "net_pnl_eur", "opportunity_cost_proxy_eur",
    ]
    return present(_result(spark, sf).select(*KEYS, TS, *cols))


@query
def equity_curve(spark, sf):
    cols = ["strategy_return", "pnl", "equity_eur", "equity_curve", "cumulative_returns", "decision"]
    return present(_result(spark, sf).select(*KEYS, TS, *cols))


@query
def equity_curve_bent(spark, sf):
    """The same with a notional so small that equity meets its bounds."""
    rows = base.clean(spark, sf).select(*KEYS, TS, (F.col(PRICE) - F.col(DAY_AHEAD)).alias("net_pnl_eur"))
    part = chunks.core(chunks.split(rows, TS), keep_chunk=True)
    out = folds.equity_curve(stage(part), "net_pnl_eur", 50.0)
    return present(out.select(*KEYS, TS, "strategy_return", "pnl", "equity_eur"))


@query
def immediate_execution(spark, sf):
    cfg = BacktestConfig(execution_delay=False)
    cols = ["position", "turnover", "delay_cost_eur", "net_pnl_eur", "equity_eur"]
    return present(_result(spark, sf, cfg).select(*KEYS, TS, *cols))


@query
def decision_accuracy_h1(spark, sf):
    cols = ["decision", "future_price_eur_mwh", "future_price_return", "directional_correct", "accuracy_status", "pnl_positive"]
    return present(_result(spark, sf).select(*KEYS, TS, *cols))


@query
def decision_accuracy_h24(spark, sf):
    rows, _ = review.review_dataset(_result(spark, sf), 24, 0.01)
    cols = ["decision", "future_price_eur_mwh", "future_price_return", "directional_correct", "accuracy_status"]
    return present(rows.select(*KEYS, TS, *cols))


@query
def accuracy_summary(spark, sf):
    return present(review.review_dataset(_result(spark, sf), 24, 0.01)[1])


def _strategies(spark, sf):
    return compare.strategy_rows(base.scored(spark, sf))


@query
def backtest_metrics(spark, sf):
    rows = stage(_strategies(spark, sf))
    out = backtest.metrics(rows, keys=[*KEYS, backtest.STRATEGY])
    return present(out, 3)


@query
def strategy_leaderboard(spark, sf):
    rows = stage(_strategies(spark, sf))
    out = compare.rank_strategies(backtest.metrics(rows, keys=[*KEYS, backtest.STRATEGY]))
    return present(out.select(*KEYS, backtest.STRATEGY, "sharpe_ratio", "total_pnl", "directional_accuracy", "rank"), 3)


@query
def pnl_attribution(spark, sf):
    return present(backtest.attribution(_result(spark, sf)), 3)


@query
def signal_family_pnl(spark, sf):
    return present(backtest.family_pnl(_result(spark, sf)), 2)


@query
def return_decomposition(spark, sf):
    return present(backtest.decomposition(_result(spark, sf)), 5, cost_drag_eur=2)


@query
def turnover_and_decisions(spark, sf):
    rows = stage(_result(spark, sf))
    return present(backtest.turnover_summary(rows).join(backtest.decision_distribution(rows), list(KEYS)))


@query
def backtest_analytics(spark, sf):
    """The nested analytics row, flattened to its leading numbers."""
    a = backtest.analytics(_result(spark, sf))
    return present(
        a.select(
            *KEYS, "row_count", F.col("decision_distribution.LONG").alias("long_count"), "final_equity", "cumulative_return",
            F.col("accuracy_summary.pending_count").alias("pending_count"),
            F.col("execution_costs.spread_cost_eur").alias("spread_cost_eur"),
            F.col("sharpe_decomposition.hit_rate").alias("hit_rate"), F.col("signal_family_pnl.forecast").alias("forecast_pnl"),
        ),
        3,
    )


@query
def trade_counts(spark, sf):
    rows = stage(_result(spark, sf))
    moves = backtest.trade_count(rows)
    labels = backtest.trade_count(rows, "decision").withColumnRenamed("trade_count", "label_count")
    return moves.join(labels, list(KEYS))


@query
def price_moves(spark, sf):
    return present(backtest.price_moves(base.clean(spark, sf).select(*KEYS, TS, PRICE)))


# ---------------------------------------------------------------- significance and ranking


def _bootstrap(spark, sf, method="iid"):
    rows = stage(_strategies(spark, sf))
    wide = stage(significance.wide_returns(rows, list(compare.STRATEGIES)))
    return stage(significance.bootstrap(wide, list(compare.STRATEGIES), method=method))


@query
def bootstrap_ci(spark, sf):
    return present(significance.sharpe_intervals(_bootstrap(spark, sf), list(compare.STRATEGIES)))


@query
def paired_significance(spark, sf):
    pairs = [(a, b) for a in compare.CANDIDATES for b in baselines.BASELINES]
    return present(significance.paired(_bootstrap(spark, sf), pairs), pnl_diff_mean=6)


@query
def poisson_bootstrap_ci(spark, sf):
    return present(significance.sharpe_intervals(_bootstrap(spark, sf, "poisson"), list(compare.STRATEGIES)))


@query
def bootstrap_prices(spark, sf):
    """Interval of one stream per series: hourly price steps on the dense daily panel."""
    rows = backtest.price_moves(base.clean(spark, sf).select(*KEYS, TS, PRICE))
    return present(significance.bootstrap_sharpe(rows, value="price_change_eur_mwh"))


@query
def compared_streams(spark, sf):
    rows = base.clean(spark, sf)
    a = rows.select(*KEYS, TS, (F.col(PRICE) - F.col(DAY_AHEAD)).alias("strategy_return"))
    b = rows.select(*KEYS, TS, F.col(RENEWABLE).alias("strategy_return"))
    return present(significance.compare_streams(a, b))


@query
def model_rank(spark, sf):
    """Three simple forecasts ranked per series by the backtest of their signals and their price error."""
    rows = baselines.with_baselines(base.scored(spark, sf))
    rows = stage(rows)
    table = None
    for name in ("persistence", "seasonal", "naive_mean_reversion"):
        one = rows.withColumns({p: F.col(f"{name}__{p}") for p in baselines.TARGETS})
        one = one.drop(*[c for c in one.columns if "__" in c])
        result = stage(backtest.backtest(one, keep_chunk=True))
        part = backtest.metrics(result).join(backtest.forecast_errors(one), list(KEYS))
        part = part.withColumn("model_key", F.lit(name)).withColumnRenamed("price_eur_mwh_mae", "price_mae")
        table = part if table is None else table.unionByName(part)
    ranked = compare.rank_models(table)
    return present(
        ranked.select(*KEYS, "model_key", "sharpe_ratio", "total_pnl", "directional_accuracy", "price_mae", "rank"), 3
    )


# ---------------------------------------------------------------- forecasting


@query
def walk_forward_folds(spark, sf):
    return forecast.walk_forward_folds(forecast.series_lengths(base.clean(spark, sf)), base.FOLDS)


@query
def first_train_rows(spark, sf):
    return forecast.first_train_rows(forecast.series_lengths(base.clean(spark, sf)), base.FOLDS)


@query
def fold_assignment(spark, sf):
    rows = chunks.number_rows(base.clean(spark, sf).select(*KEYS, TS), KEYS, TS)
    folds_ = forecast.walk_forward_folds(forecast.series_lengths(rows), base.FOLDS)
    out = joins.assign_folds(rows, folds_).withColumnRenamed(chunks.ROW, "row_number")
    return present(out.select(*KEYS, TS, "row_number", "fold", "role"))


@query
def correlation_pairs(spark, sf):
    return present(forecast.correlation_matrix(base.clean(spark, sf), [*PANEL_VALUES, SPREAD]), 6)


@query
def pruned_features(spark, sf):
    """Pruning on columns with a constant, a scaled copy and a near copy among them."""
    rows = base.clean(spark, sf).withColumns(
        {
            "constant": F.lit(7.0), "price_twice": F.col(PRICE) * 2.0, "net_load_mw": F.col(DEMAND) / 1000.0 - F.col(RENEWABLE),
        }
    )
    cols = [PRICE, "constant", "price_twice", DEMAND, RENEWABLE, "net_load_mw", DAY_AHEAD, SPREAD, IMBALANCE]
    return present(forecast.prune_features(rows, cols, base.FOLDS).drop("abs_correlation"))


REGRESSORS = ["price_eur_mwh_lag_1", "price_eur_mwh_lag_24", "net_load_mw_lag_1", "price_eur_mwh_roll_mean_24"]


def _features(spark, sf):
    """Finished features; one that has no value in a whole series is NULL there and costs no rows."""
    return stage(features.build_features(base.merged(spark, sf), needed=(*FEATURE_REQUIRED, *REGRESSORS)))


@query
def additive_forecast(spark, sf):
    scored, _ = forecast.fit_additive(_features(spark, sf), REGRESSORS, base.FOLDS)
    return present(scored.select(*KEYS, TS, PRICE, *forecast.TARGETS))


@query
def additive_effects(spark, sf):
    _, coefs = forecast.fit_additive(_features(spark, sf), REGRESSORS, base.FOLDS)
    return present(forecast.regressor_effects(coefs, REGRESSORS))


SMALL = forecast.BoostParams(trees=5, depth=3, step=0.1, row_share=1.0, column_share=1.0)


@query
def boosted_forecast(spark, sf):
    """All targets, all kept features, the default trees."""
    scored = forecast.train_with_model("boosted", _features(spark, sf), base.FOLDS)
    return present(scored.select(*KEYS, TS, PRICE, *forecast.TARGETS))


@query
def early_stopped_forecast(spark, sf):
    scored = forecast.train_boosted(_features(spark, sf), base.FOLDS, params=SMALL, early_stopping=True, cols=REGRESSORS)
    return present(scored.select(*KEYS, TS, PRICE, *forecast.TARGETS))


@query
def recurrent_forecast(spark, sf):
    """All targets, all kept features, the default network, one group per series and fold."""
    scored = forecast.train_with_model("recurrent", _features(spark, sf), base.FOLDS)
    return present(scored.select(*KEYS, TS, PRICE, *forecast.TARGETS))


@query
def recurrent_training(spark, sf):
    rows = _features(spark, sf)
    cols = forecast.selected_columns(rows, base.FOLDS)
    return present(recurrent.training_summary(recurrent.fit_recurrent(rows, cols, base.FOLDS).history))


@query
def tuned_parameters(spark, sf):
    grid = (SMALL, forecast.BoostParams(trees=5, depth=2, step=0.3, row_share=1.0, column_share=1.0))
    _, log = forecast.tune(_features(spark, sf), REGRESSORS, PRICE, base.FOLDS, grid)
    return forecast.search_log(spark, log)


def _final_model(spark, sf):
    rows = _features(spark, sf)
    frame, clock = forecast.fold_frame(rows, REGRESSORS, base.FOLDS)
    return rows, forecast.fit_final(frame, PRICE, base.FOLDS, SMALL, False, 0.01, clock)


@query
def feature_importance(spark, sf):
    _, model = _final_model(spark, sf)
    return forecast.feature_importance(model, REGRESSORS, spark)


@query
def ablation_impact(spark, sf):
    rows, model = _final_model(spark, sf)
    return forecast.ablation_impact(model, rows, REGRESSORS)


@query
def compared_models(spark, sf):
    """Two models trained, scored, backtested and ranked per series."""
    rows = _features(spark, sf)
    few = lambda f, fc, k, t: forecast.fit_additive(f, REGRESSORS[:1], fc, keys=k, ts=t)[0]
    more = lambda f, fc, k, t: forecast.fit_additive(f, REGRESSORS, fc, keys=k, ts=t)[0]
    fc = ForecastConfig(base.FOLDS.train_days, base.FOLDS.test_days)
    ranked, failures = compare.compare_models(rows, {"few": few, "more": more}, fc=fc)
    if ranked is None:
        raise RuntimeError(failures)
    return present(ranked.select(*KEYS, "model_key", "sharpe_ratio", "price_mae", "significant_vs_persistence", "rank"))


@query
def research_run(spark, sf):
    """The whole run: events, refresh by missing ranges, cleaning, features, walk-forward model, ranked strategies."""
    at = F.lit("2024-02-01").cast("timestamp")
    rows = stage(base.panel(spark, sf))
    feed = scratch(spark, "run-feed")
    rows.where(F.col(TS) >= F.lit(MIDDLE).cast("timestamp")).repartition(*KEYS).write.partitionBy(*KEYS).parquet(feed)
    old = quality.annotate_source(rows.where(F.col(TS) < F.lit(SPLIT).cast("timestamp")), REQUIRED, "feed", at)

    def fetch(missing):
        return ranges.fetch_ranges(missing, ranges.ParquetFeed(feed, PANEL_VALUES), PANEL_VALUES)

    refreshed = workflow.refresh_panel(old, rows, START, END, fetch, "feed", at, PANEL_VALUES, REQUIRED)
    energy = conform(refreshed.panel, ENERGY_SCHEMA)
    weather = quality.annotate_source(base.weather(spark, sf), WEATHER_VALUES, "weather", at)
    features_ = stage(workflow.feature_table(energy, weather))
    run = workflow.research_run(features_, "additive", fc=base.FOLDS, provenance=refreshed.provenance)
    cols = [*KEYS, backtest.STRATEGY, "sharpe_ratio", "total_pnl", "directional_accuracy", "energy_source_research_grade", "rank"]
    return present(run["strategies"].select(*cols), 3)


@query
def forecast_errors(spark, sf):
    pairs = ((PRED_PRICE, PRICE), ("pred_demand_kw", DEMAND), ("pred_renewable_mw", RENEWABLE))
    return present(backtest.forecast_errors(base.scored(spark, sf), pairs))


@query
def error_by_price_regime(spark, sf):
    return present(diagnostics.error_by_price_regime(base.scored(spark, sf)))


@query
def error_by_hour(spark, sf):
    return present(diagnostics.error_by_hour(base.scored(spark, sf)))


@query
def error_by_vol_regime(spark, sf):
    return present(diagnostics.error_by_vol_regime(base.scored(spark, sf)))


@query
def fallback_decision(spark, sf):
    return present(decision.fallback_decision(base.scored(spark, sf)), 5)


@query
def full_sample_zscore(spark, sf):
    rows = base.clean(spark, sf).select(*KEYS, TS, PRICE)
    return present(decision.full_zscore(rows, {PRICE: "z"}))


# ---------------------------------------------------------------- review


@query
def rolling_accuracy(spark, sf):
    out = review.rolling_accuracy(_result(spark, sf))
    return present(out.select(*KEYS, TS, "rolling_directional_accuracy", "rolling_pnl_positive_rate"))


@query
def latest_signal(spark, sf):
    return present(review.market_snapshot(_result(spark, sf)), 3)


@query
def decision_log(spark, sf):
    return present(review.decision_log(_result(spark, sf)))


@query
def decision_log_dates(spark, sf):
    rows = review.filter_dates(review.decision_log(_result(spark, sf)), "2024-01-10", "2024-01-12")
    return present(rows.select(*KEYS, TS, "decision", "pnl"))


@query
def last_rows_chart(spark, sf):
    return present(review.chart_series(base.clean(spark, sf), 300))


@query
def decision_events(spark, sf):
    out = review.decision_events(_result(spark, sf), 24, logged_at=F.lit("2024-02-01").cast("timestamp"))
    return present(out)


@query
def largest_moves(spark, sf):
    rows = backtest.price_moves(base.clean(spark, sf).select(*KEYS, TS, PRICE))
    out = review.top_by_size(rows.withColumn("label", F.concat_ws(" ", *KEYS, F.col(TS).cast("string"))),
                             "price_change_eur_mwh", 20, tie="label")
    return present(out.select(*KEYS, TS, "price_change_eur_mwh"))


@query
def research_summary(spark, sf):
    pairs = [(a, b) for a in compare.CANDIDATES for b in baselines.BASELINES]
    sig = significance.paired(_bootstrap(spark, sf), pairs)
    return review.research_summary(sig, quality.provenance_summary(base.candidates(spark, sf)))


# ---------------------------------------------------------------- sinks and streams


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder that all executors share."""
    from ..functions.staging import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    if os.path.isdir(root):
        return tempfile.mkdtemp(prefix=f"{name}-", dir=root)
    import uuid

    return f"{root}/{name}-{uuid.uuid4().hex}"


@query
def panel_round_trip(spark, sf):
    """Validated write by series and month, read back with the fixed schema."""
    rows = conform(base.panel(spark, sf), ENERGY_SCHEMA)
    path = _scratch(spark, "panel")
    storage.write_panel(rows, path, "energy", quality.PanelRules(version=1))
    back = storage.read_panel(spark, path, ENERGY_SCHEMA)
    return present(back.select(*KEYS, TS, PRICE, DEMAND, VERSION))


@query
def scored_csv_round_trip(spark, sf):
    path = _scratch(spark, "scored")
    storage.write_results(base.scored(spark, sf), path)
    back = storage.read_scored_csv(spark, path)
    return present(back.select(*KEYS, TS, PRICE, PRED_PRICE))


@query
def run_artifacts(spark, sf):
    """Results, metrics and analytics of a run, written and loaded again; rows and profit per series."""
    root = scratch(spark, "run")
    result = stage(_result(spark, sf))
    storage.write_results(base.scored(spark, sf), f"{root}/results")
    storage.write_metrics(backtest.metrics(result), f"{root}/metrics")
    storage.write_metrics(backtest.analytics(result), f"{root}/analytics")
    results, metrics, analytics = storage.load_run_artifacts(spark, root)
    rows = results.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("result_rows"), F.sum(PRICE).alias("price_sum"))
    out = rows.join(metrics.select(*KEYS, "total_pnl", "trade_count"), list(KEYS)).join(analytics.select(*KEYS, "row_count"), list(KEYS))
    return present(out, 3)


@query
def decision_log_json(spark, sf):
    """Events appended as JSON lines and decoded again."""
    path = _scratch(spark, "events")
    events = review.decision_events(_result(spark, sf), 24, logged_at=F.lit("2024-02-01").cast("timestamp"))
    storage.append_decision_log(events, path)
    return present(storage.decode_events(spark.read.text(path), events.schema))


def _event_stream(spark, sf):
    source = base.table(spark, sf, "events")
    # A pattern, as a stream takes a plain path for a folder only; the table may be one file or a folder of parts.
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 8).parquet(f"{sf}/events.parque[t]")
    return stream.withColumns(
        {"series_id": F.concat(F.lit("Z"), (F.col("user_id") % 4).cast("string")), TS: F.col("ts").cast("timestamp")}
    )


def _drain(spark, frame, name, mode="append"):
    """Run a stream over all available input into a folder and read the folder."""
    out, state = _scratch(spark, name), _scratch(spark, f"{name}-state")
    run = (
        frame.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def _drain_updates(spark, frame, name):
    """Run a stream in update mode; of each (series, time) the last batch that changed it counts.

    Nothing waits in the state for a watermark, so the result is complete when the input ends.
    """
    out, state = _scratch(spark, name), _scratch(spark, f"{name}-state")

    def write(batch, i):
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")

    frame.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode("update").trigger(
        availableNow=True
    ).start().awaitTermination()
    values = [c for c in frame.columns if c not in (*KEYS, TS)]
    last = F.max_by(F.struct(*values), "batch").alias("v")
    return spark.read.parquet(out).groupBy(*KEYS, TS).agg(last).select(*KEYS, TS, "v.*")


def _any_order(spark, sf) -> str:
    """A delay as long as the table: its files follow no order of time, so no row may come too late."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    ends = base.table(spark, sf, "events").agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    return f"{0 if ends['a'] is None else ends['b'] - ends['a'] + 86400} seconds"


@query
def streaming_rollup(spark, sf):
    frame = flows.hourly_rollup(_event_stream(spark, sf), ["value"], delay=_any_order(spark, sf))
    return present(_drain_updates(spark, frame, "rollup"))


@query
def streaming_dedupe(spark, sf):
    frame = _event_stream(spark, sf).withColumn(TS, F.date_trunc("hour", TS)).select(*KEYS, TS)
    return present(_drain(spark, flows.dedupe(frame, delay=_any_order(spark, sf)), "dedupe"))


@query
def streaming_windows(spark, sf):
    frame = flows.sliding_features(_event_stream(spark, sf), "value", delay=_any_order(spark, sf))
    return present(_drain_updates(spark, frame, "windows"))


@query
def streaming_ramp(spark, sf):
    """Position ramp and gross equity kept as stream state, fed from a written target table in several batches."""
    path, out, late = (scratch(spark, n) for n in ("targets", "ramp", "ramp-late"))
    rows = signals.signal_frame(base.scored(spark, sf)).select(*KEYS, TS, PRICE, "target_position")
    # Written one stretch of time after the other, so that batches come in order of time.
    rows = stage(rows.withColumns({"exposure_mwh": F.lit(1.0), "_share": F.unix_timestamp(TS)}))
    ends = rows.agg(F.min("_share").alias("a"), (F.max("_share") + 1).alias("b")).first()
    part = F.floor((F.col("_share") - F.lit(ends["a"])) * 4 / F.lit((ends["b"] or 1) - (ends["a"] or 0)))
    for k in range(4):
        rows.where(part == k).drop("_share").write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)
    settings = flows.PositionSettings(0.35, 1.0, 10000.0)
    frame = flows.position_states(stream.repartition(*KEYS), settings)
    frame.writeStream.foreachBatch(flows.split_late(out, late)).option("checkpointLocation", scratch(spark, "ramp-state")).trigger(
        availableNow=True
    ).start().awaitTermination()
    kept = spark.read.schema(frame.drop("late").schema).parquet(f"{out}/*").withColumn("late", F.lit(False))
    dropped = spark.read.schema(frame.select(*KEYS, TS).schema).parquet(f"{late}/*").withColumn("late", F.lit(True))
    return present(kept.unionByName(dropped, allowMissingColumns=True).select(*KEYS, TS, "position_after", "gross_equity_eur", "late"))


@query
def streaming_upsert(spark, sf):
    rows = base.candidates(spark, sf)
    path, state = scratch(spark, "raw"), scratch(spark, "upsert-state")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    panel = VersionedPanel(spark, scratch(spark, "upsert"))
    run = (
        stream.writeStream.foreachBatch(flows.upsert_sink(panel, tie_break=["event_id"]))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return present(panel.read().select(*KEYS, TS, PRICE, QUALITY, "event_id"))


@query
def versioned_panel(spark, sf):
    """Two overlapping halves merged month by month into a published panel; the second half comes twice."""
    rows = base.candidates(spark, sf)
    panel = VersionedPanel(spark, scratch(spark, "versions"), rules=quality.PanelRules(required=(PRICE,)))
    best = lambda df: quality.upsert_by_quality(df, tie_break=["event_id"])
    panel.merge(rows.where(F.col(TS) < F.lit(SPLIT).cast("timestamp")), best, "feed", 0)
    for _ in range(2):
        panel.merge(rows.where(F.col(TS) >= F.lit(MIDDLE).cast("timestamp")), best, "feed", 1)
    return present(panel.read().select(*KEYS, TS, PRICE, QUALITY, "event_id"))


@query
def ranges_from_source(spark, sf):
    """The panel kept as files, read back range by range: every whole week of every series is a range."""
    path = scratch(spark, "feed")
    rows = base.panel(spark, sf).select(*KEYS, TS, *PANEL_VALUES)
    rows.repartition(*KEYS).write.partitionBy(*KEYS).parquet(path)
    spans = gaps.series_bounds(rows).withColumnsRenamed({"start": "range_start", "end": "range_end"})
    spans = spans.withColumn("range_end", F.col("range_end") + F.expr("INTERVAL 1 HOUR"))
    weeks = gaps.chunk_ranges(spans, 7).withColumnsRenamed({"chunk_start": "range_start", "chunk_end": "range_end"})
    got, _ = ranges.fetch_ranges(weeks, ranges.ParquetFeed(path, PANEL_VALUES), PANEL_VALUES)
    return present(got)


@query
def streaming_decision_log(spark, sf):
    path, log, state = _scratch(spark, "events"), _scratch(spark, "log"), _scratch(spark, "log-state")
    events = review.decision_events(_result(spark, sf), 24, logged_at=F.lit("2024-02-01").cast("timestamp"))
    events.write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    flows.decision_log(stream, log, state).awaitTermination()
    return present(storage.decode_events(spark.read.text(log), events.schema))


# ---------------------------------------------------------------- flagship


@query
def gap_repaired_features(spark, sf):
    """Hourly rollup, full grid, gap repair, and 24-hour causal features per series."""
    rows = base.clean(spark, sf)
    part = chunks.split(rows, TS, back=24)
    w = ordered(chunks.chunk_keys(KEYS), TS)
    day = w.rowsBetween(-23, 0)
    enough = F.count(PRICE).over(day) >= 24
    part = part.withColumns(
        {
            "lag_1": F.lag(PRICE, 1).over(w),
            "lag_24": F.lag(PRICE, 24).over(w),
            "mean_24": F.when(enough, F.avg(PRICE).over(day)),
            "std_24": F.when(enough, F.stddev_samp(PRICE).over(day)),
        }
    )
    out = chunks.core(part)
    return present(out.select(*KEYS, TS, PRICE, "had_gap", "lag_1", "lag_24", "mean_24", "std_24"))

