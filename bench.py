"""Headline timings: one JSON line. Uses $BENCH_SF_DIR and $BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from wattline.functions.staging import stage  # noqa: E402
from wattline.operators import backtest, compare, gaps, signals, significance  # noqa: E402
from wattline.plans import base  # noqa: E402
from wattline.plans.catalog import QUERIES  # noqa: E402
from wattline.schema import KEYS, TS  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def sink(df):
    """Compute every column of every row without collecting it."""
    df.write.format("noop").mode("overwrite").save()


def users_rollup(spark, sf):
    """One series per user: 1,500 x 720 hours at sf0.1."""
    return base.panel(spark, sf, per_user=True)


def users_repaired(spark, sf):
    return base.clean(spark, sf, per_user=True)


def users_signals(spark, sf):
    return signals.signal_frame(base.scored(spark, sf, per_user=True))


def users_six_strategies(spark, sf):
    rows = stage(compare.strategy_rows(base.scored(spark, sf, per_user=True)))
    return backtest.metrics(rows, keys=[*KEYS, backtest.STRATEGY])


def paired_bootstrap(spark, sf):
    """250 paired replicates of six streams on four series."""
    rows = stage(compare.strategy_rows(base.scored(spark, sf)))
    wide = stage(significance.wide_returns(rows, list(compare.STRATEGIES)))
    return significance.sharpe_intervals(significance.bootstrap(wide, list(compare.STRATEGIES)), list(compare.STRATEGIES))


def missing(spark, sf):
    rows = base.aligned(spark, sf, per_user=True)
    rows = rows.withColumn("data_quality", F.when(F.col("price_eur_mwh").isNotNull(), F.lit("real")))
    return gaps.missing_ranges(rows, ["price_eur_mwh"])


BENCH = {
    "hourly_rollup": QUERIES["hourly_rollup"],
    "gap_repaired_features": QUERIES["gap_repaired_features"],
    "users_rollup": users_rollup,
    "users_missing_ranges": missing,
    "users_repaired": users_repaired,
    "users_signals": users_signals,
    "dense_windows": QUERIES["dense_windows"],
    "backtest_metrics": QUERIES["backtest_metrics"],
    "paired_bootstrap": paired_bootstrap,
    "upsert_by_quality": QUERIES["upsert_by_quality"],
}

# Minutes rather than seconds on one machine; run by name: python bench.py users_six_strategies
LONG = {"users_six_strategies": users_six_strategies}


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or list(BENCH)
    sink(BENCH["hourly_rollup"](spark, SF))  # warm the JVM
    times = {}
    for name in wanted:
        start = time.time()
        sink({**BENCH, **LONG}[name](spark, SF))
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": SF}))


if __name__ == "__main__":
    main()
