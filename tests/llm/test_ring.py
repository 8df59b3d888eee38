"""The ring of op10 against plain search, and how little one more shard moves."""

import random

from pyspark.sql import functions as F

from wattline.llm import sharding


def nodes_of(spark, shards, nodes, positions):
    rows = spark.range(shards * nodes).select(
        F.expr(f"CAST(id DIV {nodes} AS INT)").alias("s"),
        F.pmod(F.xxhash64(F.lit("node"), F.expr(f"id DIV {nodes}"), F.col("id") % nodes), F.lit(positions)).alias("at"),
    )
    return [(r["s"], r["at"]) for r in rows.collect()]


def test_order_of_shards_is_that_of_their_next_nodes(spark):
    shards, nodes, positions = 5, 8, 256
    at = nodes_of(spark, shards, nodes, positions)
    for r in sharding.ring(spark, shards, nodes, positions).collect():
        gap = {s: min((a - r["position"]) % positions for t, a in at if t == s) for s in range(shards)}
        assert r["order"] == sorted(gap, key=lambda s: (gap[s], s)), r


def test_one_more_shard_leaves_the_nodes_of_the_others(spark):
    assert set(nodes_of(spark, 8, 16, 65536)) <= set(nodes_of(spark, 9, 16, 65536))
    before, after = (
        {r["position"]: r["order"][0] for r in sharding.ring(spark, n, 128).collect()} for n in (8, 9)
    )
    moved = [p for p in before if before[p] != after[p]]
    assert all(after[p] == 8 for p in moved) and 0.06 < len(moved) / len(before) < 0.17


def test_bounded_loads_move_little_more(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randint(50, 150)))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    place = lambda n: {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, shards=n).select("doc_id", "shard").collect()}
    before, after = place(8), place(9)
    moved = [d for d in before if before[d] != after[d]]
    assert len(moved) / len(rows) < 0.25 and sum(after[d] != 8 for d in moved) / len(rows) < 0.12
