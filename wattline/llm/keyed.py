"""Joins on keys that may hold a third of all rows, and gapless numbers in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shuffle_partitions, staged

#: A key is hot when it holds more than this part of all rows, so there are never more hot keys than its inverse.
HOT_PART = 1 / 4096

#: crc32 of a decimal, in SQL that has no such function: eight shifts per byte, by the reflected polynomial.
CRC32 = """xor(list_reduce(
    list_concat([4294967295::UBIGINT], list_transform(string_split({x}::VARCHAR, ''), lambda b: ascii(b)::UBIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
        lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)), 4294967295::UBIGINT)"""


def join_per_key(rows: DataFrame, per_key: DataFrame, on: list[str], n: str, part: float = HOT_PART, least: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with a table of one row per key, however uneven the keys are.

    Column ``n`` of ``per_key`` is the number of rows of the key. Keys with more than ``part`` of all rows are
    broadcast; since their rows add up to at most all rows, there are at most 1/part of them. The others are
    joined by shuffling and none of them is large. ``rows`` is read twice: give it staged. Keys are not null.
    """
    total = per_key.agg(F.sum(n)).first()[0] or 0
    many = F.col(n) > max(total * part, least)
    heavy, light = per_key.where(many).drop(n), per_key.where(~many).drop(n)
    hot = rows.join(F.broadcast(heavy), on)
    cold = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    return hot.unionByName(cold)


def number_in_order(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """``df`` written in the given order with gapless numbers from 0.

    Rows are range partitioned, sorted and numbered inside each partition; the sizes of the partitions before
    are added from a table of one row per partition. End ``order`` with a column that differs between equal
    rows, else these share a partition.
    """
    n = shuffle_partitions(df.sparkSession)
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = staged(sorted_.withColumn("__m", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumns({"__p": F.shiftright("__m", 33), "__r": F.col("__m").bitwiseAND(2**33 - 1)}).drop("__m")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    return rows.join(F.broadcast(starts), "__p").withColumn(name, F.col("__from") + F.col("__r")).drop("__p", "__r", "__from")
