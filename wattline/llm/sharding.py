"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

The ring has 2^16 positions. A text's hash gives its position, so equal texts are one unit; each shard
owns several virtual nodes. No shard may hold more than (1 + slack) times the mean load: a unit whose
shard is full goes on clockwise to the next shard that has room. Units are positions of the ring, heavy
ones first, so the assignment works on a table of bounded size whatever the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import staged

POSITIONS = 1 << 16
#: A position that weighs more than this part of a shard's mean load is taken apart by text.
HEAVY = 1 / 512
SLACK = 1 / 500
ROWS_PER_BIN = 50_000


def ring(spark: SparkSession, shards: int, nodes: int, positions: int = POSITIONS) -> DataFrame:
    """(position, shards array): for every position the shards in the order in which they come clockwise.

    A virtual node's place follows from its shard and its number alone, so one more shard leaves the nodes of the
    others where they are and takes over only the arcs before its own.
    """
    all_ = spark.range(positions).select(F.col("id").alias("position"))
    place = F.xxhash64(F.lit("node"), F.expr(f"id DIV {nodes}"), F.col("id") % nodes)
    owned = spark.range(shards * nodes).select(F.pmod(place, F.lit(positions)).alias("at"), F.expr(f"CAST(id DIV {nodes} AS INT)").alias("s"))
    first = owned.groupBy("at").pivot("s", list(range(shards))).agg(F.lit(True))
    marked = all_.join(first, F.col("position") == F.col("at"), "left").drop("at")
    ahead = Window.orderBy(F.col("position").desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = lambda s: F.when(F.col(str(s)), F.col("position"))
    # Two turns of the ring, so that what lies behind a position is also ahead of it.
    turns = marked.unionByName(marked.withColumn("position", F.col("position") + positions))
    gaps = [(F.min(here(s)).over(ahead) - F.col("position")).alias(f"g{s}") for s in range(shards)]
    order = F.array_sort(F.array(*[F.struct(F.col(f"g{s}").alias("gap"), F.lit(s).alias("shard")) for s in range(shards)]))
    ordered = turns.select("position", *gaps).where(F.col("position") < positions)
    return ordered.select("position", F.transform(order, lambda x: x["shard"]).alias("order"))


def place(units: DataFrame, ring_: DataFrame, shards: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """Bounded-load placement of ``units`` (unit, position, weight, shard), shard null where open.

    In round j every open unit asks for the j-th shard clockwise; a shard takes the heaviest while its
    load stays within ``limit``. A shard that is too full for a unit stays so, thus one round per shard
    decides all. Returns the placed units and those that fit nowhere.
    """
    now = staged(units.join(ring_, "position"), "ring-units")
    heavy_first = Window.partitionBy("asked").orderBy(F.col("placed").desc(), F.col("weight").desc(), "unit")
    for j in range(shards):
        asked = F.coalesce("shard", F.element_at("order", j + 1))
        tried = now.withColumns({"asked": asked, "placed": F.col("shard").isNotNull()})
        load = F.sum("weight").over(heavy_first.rowsBetween(Window.unboundedPreceding, 0))
        now = staged(tried.withColumn("shard", F.when(F.col("placed") | (load <= limit), F.col("asked"))).drop("asked", "placed"), "ring-round")
    return now.drop("order"), now.where("shard IS NULL").drop("order")


def shard_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8, nodes: int = 128, slack: float = SLACK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: no shard holds more than (1 + slack) times the mean of sizes, as long as single
    rows are smaller than the slack. size is the UTF-8 length plus 1; null text counts as empty. Equal texts share a shard, unless their group alone
    fits in no shard's room; then the group's rows are dealt in parts. slot numbers each shard's rows from 0
    without gaps, equal texts next to each other; repeated rows get a slot each. grown_shard is null under
    this law. Rows without doc_id are placed by their text. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"),
    )
    rows = staged(rows.withColumn("position", F.pmod("key", F.lit(POSITIONS))), "shard-rows")
    whole = rows.groupBy("position").agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
    whole = staged(whole, "ring-load")
    mean = (whole.agg(F.sum("weight")).first()[0] or 0) / shards
    part = mean * HEAVY
    # A unit is a light position, or a text of a heavy one: (position, key) with key null for whole positions.
    heavy = whole.where(F.col("weight") > part).select("position")
    light = whole.where(F.col("weight") <= part).select("position", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("deal"), "weight")
    parts = max(1, shards * 8)
    texts = rows.join(heavy, "position").groupBy("position", "key").agg(F.sum("size").alias("weight"))
    big = texts.select("position", "key", F.lit(None).cast("long").alias("deal"), "weight")
    ring_ = staged(ring(spark, shards, nodes), "ring")
    named = F.xxhash64("position", F.coalesce("key", F.lit(0)), F.coalesce("deal", F.lit(-1).cast("long")))
    units = light.unionByName(big).withColumns({"unit": named, "shard": F.lit(None).cast("int")})
    limit = mean * (1 + slack)
    # Heavy units first; a light one weighs less than the slack and then always fits somewhere.
    placed, open_ = place(units.where(F.col("weight") > part), ring_, shards, limit)
    if not open_.isEmpty():
        # Groups that fit nowhere: their rows are dealt into parts by id, each a unit of its own.
        dealt = rows.join(open_.select("position", F.col("key").alias("k")), "position").where("k IS NULL OR k = key")
        dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("doc_id", "position"), F.lit(parts)))
        split = dealt.groupBy("position", F.col("k").alias("key"), "deal").agg(F.sum("size").alias("weight"))
        split = split.withColumns({"unit": named, "shard": F.lit(None).cast("int")})
        kept = placed.where("shard IS NOT NULL")
        placed, open_ = place(kept.unionByName(split), ring_, shards, limit)
        # What still fits nowhere is larger than any room left: it goes to its own shard on the ring.
        own = ring_.select("position", F.element_at("order", 1).alias("own"))
        placed = placed.join(own, "position").withColumn("shard", F.coalesce("shard", "own")).drop("own")
    placed, open_ = place(placed.unionByName(units.where(F.col("weight") <= part)), ring_, shards, limit)
    least = placed.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("weight").alias("w")).orderBy("w", "shard").first()
    placed = placed.withColumn("shard", F.coalesce("shard", F.lit(least["shard"] if least else 0)))
    placed = staged(placed.select("position", "key", "deal", "shard"), "ring-placed")
    by_position = placed.where("key IS NULL AND deal IS NULL").select("position", F.col("shard").alias("s0"))
    by_key = placed.where("key IS NOT NULL AND deal IS NULL").select("position", "key", F.col("shard").alias("s1"))
    by_deal = placed.where("deal IS NOT NULL").select(F.col("position").alias("p"), F.col("key").alias("k"), F.col("deal").alias("d"), F.col("shard").alias("s2"))
    deal = F.pmod(F.xxhash64("doc_id", "position"), F.lit(parts))
    out = rows.join(by_position, "position", "left").join(by_key, ["position", "key"], "left")
    out = out.withColumn("deal", deal).join(by_deal, (F.col("position") == F.col("p")) & (F.col("deal") == F.col("d")) & F.coalesce(F.col("k") == F.col("key"), F.lit(True)), "left")
    out = out.withColumn("shard", F.coalesce("s2", "s1", "s0")).select("doc_id", "size", "text_crc32", "key", "position", "shard")
    return _slots(out, whole)


def _slots(rows: DataFrame, load: DataFrame) -> DataFrame:
    """Numbers within a shard: bins of a bounded number of rows are counted, then rows within bins."""
    bins = load.select("position", F.ceil(F.col("n") / ROWS_PER_BIN).alias("bins"))
    binned = rows.join(bins, "position").withColumn("bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), "bins"))
    binned = staged(binned, "sharded")
    counts = binned.groupBy("shard", "position", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("position", "bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "position", "bin").orderBy("key", "doc_id")
    slots = binned.join(starts, ["shard", "position", "bin"]).withColumn("slot", F.col("from") + F.row_number().over(within) - 1)
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
