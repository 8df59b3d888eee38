"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest, anti-joined
with the index by sort-merge (the index side needs no shuffle, its buckets are the partitions) and what is
new is appended. DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_path, shuffle_partitions, staged

SCHEMA = "digest BINARY, keep_id BIGINT"


class DigestIndex:
    """Digests of all texts kept so far, at ``path`` in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or shuffle_partitions(spark)
        self.table = "digests_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.read.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """One file per bucket and batch: rows are dealt by the bucket's own hash before the write."""
        dealt = rows.select("digest", "keep_id").repartition(self.buckets, "digest")
        write = dealt.write.format("parquet").mode("append").option("path", self.path)
        write.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)


def dedupe(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; new digests join the index.

    ``row`` names a column that numbers the rows: of repeated rows the first is kept, and column row names it (else null).

    Null text counts as empty. Of equal texts in the batch the largest doc_id stays (a null id is the
    smallest; repeated rows keep one). A text already in the index stays as the index has it, so every
    row of the batch with that text goes and keep_id is the id stored there. group_size counts the rows
    of the batch. Other columns of ``docs`` are not used. An empty batch gives no rows.
    """
    hashed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)).alias("digest"),
        (F.col(row) if row else F.lit(0)).cast("long").alias("row"),
    )
    rows = staged(hashed.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"), F.min("row").alias("row")), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.sum("copies").alias("group_size"))
    known = index.read().select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
    groups = staged(groups.join(known.hint("merge"), "digest", "left"), "digest-groups")
    fresh = groups.where("known IS NULL").select("digest", F.col("last_id").alias("keep_id"))
    index.append(fresh.join(index.read().hint("merge"), "digest", "left_anti"))
    labelled = rows.join(groups, "digest").select(
        "doc_id", "digest", "known", "group_size", "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"),
        F.when(F.col("known"), F.col("known_id")).otherwise(F.col("last_id")).alias("keep_id"),
    )
    first = F.col("known").isNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    out = ["doc_id", "keep_id", "group_size", first.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return labelled.select(*out, *([F.when(first, F.col("row")).alias("row")] if row else []))


def dedupe_once(docs: DataFrame, **columns) -> DataFrame:
    """``dedupe`` against a new, empty index in the shared folder."""
    spark = docs.sparkSession
    return dedupe(docs, DigestIndex(spark, new_path(spark, "digest-index")), **columns)


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
