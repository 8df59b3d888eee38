"""The flow from raw panels to features as one piece."""

from pyspark.sql import functions as F

from wattline.operators import quality
from wattline.plans import base, workflow
from wattline.schema import ENERGY_SCHEMA, KEYS, PRICE, TS, WEATHER_VALUES, conform

SF = "/root/testdata/sf0.01"  # the smallest table whose filled panel passes the gate on missing values


def test_feature_table_from_raw_panels(spark):
    at = F.lit("2024-02-01").cast("timestamp")
    energy = conform(quality.annotate_source(base.clean(spark, SF).drop("had_gap"), (PRICE,), "feed", at), ENERGY_SCHEMA)
    # A repeated hour and an hour without a time must not reach the features.
    energy = energy.unionByName(energy.limit(5)).unionByName(energy.limit(1).withColumn(TS, F.lit(None).cast("timestamp")))
    weather = quality.annotate_source(base.weather(spark, SF), WEATHER_VALUES, "weather", at)
    out = workflow.feature_table(energy, weather)
    assert len(set(out.columns)) == len(out.columns) and "had_gap" not in out.columns
    rows = out.select(*KEYS, TS).collect()
    assert len(rows) == len(set(rows)) > 2000
