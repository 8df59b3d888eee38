"""Cases that once gave wrong answers."""

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from wattline.operators import forecast, quality
from wattline.plans import catalog


def _hours(spark, rows):
    df = spark.createDataFrame(rows, "series_id string, h int, x double, data_quality string")
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("h") * 3600)
    return df.withColumns({"timestamp_utc": ts, "fetch_timestamp_utc": ts}).drop("h")


def test_merge_takes_new_rows_of_the_window_only(spark):
    old = _hours(spark, [("a", 0, 1.0, "real"), ("a", 5, 2.0, "real"), ("a", None, 9.0, "real")])
    new = _hours(spark, [("a", 0, 3.0, "real"), ("a", 5, 4.0, "synthetic"), ("a", 6, 5.0, "real")])
    out = quality.incremental_merge(old, new, "2024-01-01 04:00:00", "2024-01-01 06:00:00")
    got = sorted((r["x"]) for r in out.collect())
    assert got == [1.0, 2.0, 5.0, 9.0]


def test_one_empty_series_is_refused(spark):
    full = [("a", h, 1.0, "real") for h in range(100)]
    none = [("b", h, None, "real") for h in range(4)]
    quality.require_input(_hours(spark, full), ["x"])
    with pytest.raises(ValueError, match="too many missing"):
        quality.require_input(_hours(spark, full + none), ["x"])
    with pytest.raises(ValueError, match="empty"):
        quality.require_input(_hours(spark, []), ["x"])


class _FirstColumnOnly:
    """A model that uses one feature of two."""

    def transform(self, df):
        from pyspark.ml.functions import vector_to_array

        return df.withColumn("_pred", vector_to_array("_features")[0])


def test_ablation_keeps_series_apart_and_scores_all_rows(spark):
    data = [(k, float(i), float(7 * i % 11)) for k, base in (("a", 0), ("b", 1000)) for i in range(base, base + 200)]
    df = spark.createDataFrame(data, "series_id string, x double, z double")
    got = {r["feature"]: r["ablation_impact"] for r in forecast.ablation_impact(_FirstColumnOnly(), df, ["x", "z"]).collect()}
    assert got == {"x": 50.0, "z": 0.0}


@pytest.mark.parametrize("name", ["streaming_rollup", "streaming_windows", "streaming_dedupe"])
def test_stream_of_a_folder_equals_stream_of_one_file(spark, tmp_path, name):
    many = str(tmp_path)
    spark.read.parquet(f"{SF}/events.parquet").repartition(12, "event_id").write.parquet(f"{many}/events.parquet")
    assert rows(catalog.QUERIES[name](spark, many)) == rows(catalog.QUERIES[name](spark, SF))
