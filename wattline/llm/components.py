"""Connected components by alternating star contraction: every round is joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(moved.unionByName(low.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that is not itself a root; root is the smallest node.

    A node's neighbours are never gathered: each round links them to the smallest one known, so a node
    with very many links costs one grouped minimum. Rounds end when nothing moves, after a number that
    grows with the logarithm of the longest chain.
    """
    e = staged(_oriented(edges), "links")
    before = None
    while True:
        e = staged(_small_star(_large_star(e)), "star")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
