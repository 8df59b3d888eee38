"""Files: panels, scored rows, results, metrics, logs and the run index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators import quality
from ..schema import KEYS, SCORED_SCHEMA, TS, conform
from . import feeds


def read_panel(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet with a fixed schema: missing columns as NULL, casts, fixed column order."""
    return conform(spark.read.parquet(path), schema)


def read_scored_csv(spark: SparkSession, path: str, schema: T.StructType = SCORED_SCHEMA) -> DataFrame:
    """Scored rows from CSV by header name; unreadable cells become NULL."""
    names = spark.read.option("header", True).csv(path)
    return conform(names, schema)


def read_hourly_arrays(spark: SparkSession, path: str) -> DataFrame:
    return feeds.explode_hourly(spark.read.schema(feeds.HOURLY_SCHEMA).json(path))


def write_panel(
    df: DataFrame, path: str, dataset: str, rules: quality.PanelRules, keys=KEYS, ts: str = TS
) -> None:
    """Validate, then replace only the partitions of the series in ``df``.

    A failed validation raises before anything is written, so the old data stay. Files are split by
    series and month, so a long series is many files and a time filter prunes folders.
    """
    quality.raise_on_violations(quality.validate_panel(df, rules, keys, ts))
    out = df.withColumns({"dataset": F.lit(dataset), "month": F.date_format(ts, "yyyy-MM")})
    parts = ["dataset", *keys, "month"]
    (
        out.repartition(*[F.col(c) for c in parts])
        .sortWithinPartitions(*parts, ts)
        .write.partitionBy(*parts)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metrics or analytics rows as JSON, nested columns kept."""
    df.write.mode(mode).json(path)


def event_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def append_decision_log(events: DataFrame, path: str) -> None:
    event_json(events).write.mode("append").text(path)


SECRET_WORDS = ("api_key", "token", "secret", "password")

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("timestamp_utc", T.TimestampType()),
        T.StructField("model", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("lookback_days", T.IntegerType()),
        T.StructField("energy_source", T.StringType()),
        T.StructField("research_grade", T.BooleanType()),
        T.StructField("config_snapshot", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("winner_model", T.StringType()),
        T.StructField("winner_sharpe_ratio", T.DoubleType()),
    ]
)


def masked(config: dict) -> dict:
    """Settings as text; values of secret-like names are hidden."""
    hide = lambda n: any(w in n.lower() for w in SECRET_WORDS)
    return {
        n: ("***set***" if v else None) if hide(n) else (None if v is None else str(v)) for n, v in config.items()
    }


def append_run_index(spark: SparkSession, run: dict, path: str) -> DataFrame:
    """Append one run row and return all runs."""
    row = {f.name: run.get(f.name) for f in RUN_SCHEMA.fields}
    row["config_snapshot"] = masked(run.get("config_snapshot") or {})
    row["metrics"] = {k: float(v) for k, v in (run.get("metrics") or {}).items() if v is not None}
    spark.createDataFrame([tuple(row.values())], RUN_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def load_run_artifacts(spark: SparkSession, root: str, schema: T.StructType = SCORED_SCHEMA):
    """(results, metrics, analytics) of one run; a missing part raises."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    names = ("results", "metrics", "analytics")
    for name in names:
        folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if not folder.getFileSystem(conf).exists(folder):
            raise FileNotFoundError(f"run artifacts are incomplete: {root}/{name} is missing")
    return (
        read_scored_csv(spark, f"{root}/results", schema),
        spark.read.json(f"{root}/metrics"),
        spark.read.json(f"{root}/analytics"),
    )


def decode_events(df: DataFrame, schema: T.StructType, column: str | Column = "value") -> DataFrame:
    return df.select(F.from_json(column, schema).alias("_e")).select("_e.*")
