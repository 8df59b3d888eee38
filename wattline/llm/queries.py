"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    exact_dedup, fingerprints, langid, language_model, line_dedup, merkle, mixing, packing, prefix_trie, sharding, simhash, toxicity, warc,
)
from .common import documents, id_fold
from .shipping import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedupe_once(documents(spark, sf_dir))


ORACLES["op6_exact_dedup"] = exact_dedup.SQL


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe_lines(documents(spark, sf_dir), with_text=False).drop("kept_text")


ORACLES["op7_line_dedup"] = line_dedup.SQL


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


@query
def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model).withColumn("held_out", id_fold("doc_id", 5) == 0)
    return scored.select("doc_id", "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_length", "worst_score")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify_documents(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "declared", "language", "posterior", "letters", "kept")


@query
def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = langid.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "declared", "language", "posterior", "letters", "kept")


@query
def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


@query
def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


@query
def op11_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    back = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op11_warc_chunks"] = warc.SQL


@query
def op12_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir)).drop("siblings")


ORACLES["op12_merkle_climb"] = merkle.SQL


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op13_prefix_trie"] = prefix_trie.SQL
