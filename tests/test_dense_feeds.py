"""Features of feeds so dense that an hourly minimum or maximum never moves."""

import datetime as dt

from pyspark.sql import functions as F

from wattline.operators import forecast
from wattline.plans import base, catalog
from wattline.schema import TS

KINDS = ("purchase", "view", "click", "signup", "error")


def test_constant_weather_costs_no_series(spark, tmp_path):
    """Series Z0 sees the lowest and highest counter in every hour, Z1 does not: a z-score of Z0 has no value at all."""
    start, made = dt.datetime(2024, 1, 1), []
    for hour in range(24 * 24):
        for user in (0, 1):
            for i, kind in enumerate(KINDS):
                k = {0: 0, 1: 99}.get(i, 30) if user == 0 else (hour * 7 + 13 * i) % 100
                value = float((hour * (3 + i) + 5 * user) % 37) + i
                made.append((len(made), start + dt.timedelta(hours=hour, minutes=i), user, kind, value, f'{{"k": {k}}}'))
    rows = spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    found = catalog._features(spark, str(tmp_path))
    per = {r["series_id"]: r for r in found.groupBy("series_id").agg(F.count("*").alias("n"), F.count("wind_speed_mps_anomaly").alias("wind"), F.count("temperature_c_anomaly").alias("warm")).collect()}
    assert set(per) == {"Z0", "Z1"} and per["Z0"]["n"] == per["Z1"]["n"] > 500
    assert per["Z0"]["wind"] == 0 and per["Z1"]["wind"] == per["Z1"]["n"]
    assert found.where(" OR ".join(f"{c} IS NULL" for c in (TS, *catalog.REGRESSORS))).isEmpty()
    clock = forecast.time_folds(found, base.FOLDS)
    assert clock.count == 1 and clock.train > 0
    assert "wind_speed_mps_anomaly" in found.columns and forecast.selected_columns(found, base.FOLDS)


def test_weather_that_moves_late_costs_no_earlier_rows(spark, tmp_path):
    """The lowest and highest counter of Z0 move in one late hour: the rows before it stay, and with them the folds."""
    start, made = dt.datetime(2024, 1, 1), []
    for hour in range(24 * 24):
        for user in (0, 1):
            for i, kind in enumerate(KINDS):
                k = {0: 0, 1: 99}.get(i, 30) if user == 0 and hour != 530 else (hour * 7 + 13 * i) % 100
                value = float((hour * (3 + i) + 5 * user) % 37) + i
                made.append((len(made), start + dt.timedelta(hours=hour, minutes=i), user, kind, value, f'{{"k": {k}}}'))
    rows = spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    found = catalog._features(spark, str(tmp_path))
    per = {r["series_id"]: r for r in found.groupBy("series_id").agg(F.count("*").alias("n"), F.count("wind_speed_mps_anomaly").alias("wind")).collect()}
    assert per["Z0"]["n"] == per["Z1"]["n"] > 500 and 0 < per["Z0"]["wind"] < 60
    assert forecast.time_folds(found.where("series_id = 'Z0'"), base.FOLDS).count == 1
