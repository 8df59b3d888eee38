"""Cut lineage where one frame feeds several branches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a scratch folder only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="wattline-checkpoint-")
    sc.setCheckpointDir(named)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and continue from the written rows.

    A checkpoint also records every constraint Catalyst can derive for its rows. With the many aliased
    columns of a feature table that derivation grows beyond any use, so it is off during the call.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(name, before)
