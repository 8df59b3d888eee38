"""Session settings every flow relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.shipping import ship


def prepare(spark: SparkSession) -> SparkSession:
    """UTC times, and the package on the workers. Partitioning is stated where it matters (``chunks.split``)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark
