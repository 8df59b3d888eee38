"""Helpers shared by the corpus operators: staging in the shared folder, row numbers, document rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shipping import ship

#: Used only where a local session names no shared folder.
_OWN: list[str] = []

#: Setting: remove the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Id under which rows without doc_id are compared; it sorts after every other id.
NULL_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local session that names none gets a scratch folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="wattline-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from the written rows: no lineage, no second computation.

    Nothing reads the shuffles of the write again, so Spark removes them at its end instead of when the driver next
    collects garbage; over many rounds they would fill the executors' disks.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``. A missing id counts as empty text (remainder 0)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")) % k


def row_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Gapless row numbers from 0 in the given order, without a task that sees all rows.

    Rows are range partitioned and sorted, numbered inside each partition, written, and shifted by the
    sizes of the partitions before. Those sizes are one small row per partition. Rows that tie in
    ``order`` are numbered in an arbitrary order.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    numbered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = staged(numbered.withColumn("__m", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumns({"__p": F.shiftright("__m", 33), "__r": F.col("__m").bitwiseAND(2**33 - 1)}).drop("__m")
    sizes = sorted((r["__p"], r["n"]) for r in rows.groupBy("__p").agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, size in sizes:
        starts[p], total = total, total + size
    if not starts:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("__p", "__r")
    at = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    return rows.withColumn(name, F.col("__r") + at[F.col("__p")]).drop("__p", "__r")
