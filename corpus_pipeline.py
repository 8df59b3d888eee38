"""A training corpus from raw documents: five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns documents; its result is written as Parquet and read
again as the next stage's input. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import exact_dedup, langid, mixing, near as near_copies, packing
from wattline.llm.common import new_path, staged
from wattline.llm.queries import tokenizer_path
from wattline.llm.shipping import ship


def _same_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number that stays the same however often the rows are read; decisions are joined back by it.

    Rows read from files are numbered by file and place in it, so no text is written again. Others, also files' rows
    that come several times, are written with their number.
    """
    try:
        place = docs.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    except AnalysisException:
        place = None
    if place is not None:
        files = sorted(r["f"] for r in place.select("f").distinct().collect())
        if files and place.groupBy("f", "i").count().where("count > 1").isEmpty():
            number = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(f), F.lit(i << 40))])
            return docs.withColumn("__row", number[F.col("_metadata.file_path")] + F.col("_metadata.row_index"))
    return staged(docs.withColumn("__row", F.monotonically_increasing_id()), "stage-rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told; nothing to read or no likely language goes."""
    ship(spark)
    rows = _same_rows(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    asked = rows.select(F.col("__row").alias("id"), F.col("text").alias("t"), F.col("lang").alias("tag"), F.col("source").alias("host"))
    kept = langid.identify(asked).where("kept").select(F.col("id").alias("__row"))
    return rows.join(kept, "__row", "left_semi").drop("__row")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of equal texts, that with the largest doc_id."""
    ship(spark)
    rows = _same_rows(docs)
    kept = exact_dedup.dedupe_once(rows, row="__row").where("kept").select(F.col("row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").drop("__row")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the smallest doc_id.

    op4's fingerprint components come first. Near-duplicates have a Jaccard similarity of at least 0.8 over five-word
    shingles: links of the components are checked by it, and min-hash bands find those that three bits miss.
    """
    ship(spark)
    rows = _same_rows(docs)
    groups = near_copies.groups(rows).withColumnRenamed("id", "__row")
    ids = rows.select("__row", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"))
    grouped = groups.join(ids, "__row")
    first = grouped.groupBy("group").agg(F.min(F.struct("id", "__row")).alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(first, "__row", "left_semi").drop("__row")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix says: not at all, once or twice."""
    ship(spark)
    rows = _same_rows(docs)
    # Draws depend on ids and texts only, so the row numbers change nothing but where the copies land.
    copies = mixing.mix(rows, row="__row").where("copies > 0").select(F.col("row").alias("__row"), "copies")
    taken = rows.join(copies, "__row").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.drop("__row", "copies", "nth")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of up to 2048 ids."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", pack)]

#: Fingerprints, samples and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{name}")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
