"""Near-duplicates by the Jaccard similarity of five-word shingles: fingerprints and min-hash bands propose, sets decide.

First come the fingerprint components of ``simhash.classes``: a row and the first row of its component are linked if
their shingle sets are similar. What three bits of 64 miss is found by 80 min-hashes in 20 bands of four: two texts at
similarity 0.8 share a band with probability 0.99997. Texts that share one are compared with one leader of the band
each, in a few rounds; once those links are joined to groups, rows that still meet another group in a band are compared
with all shingle sets of the band, inside tasks in blocks. A block returns a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .common import shuffle_partitions, staged
from .components import components

WORDS, BANDS, ROWS = 5, 20, 4
LEAST = 0.8
_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Rounds of comparing with one leader a band, before all pairs that are left.
LEADERS = 3
#: Rows of one band that are compared in one piece; larger bands are dealt out in such blocks.
BLOCK = 1024


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted different XXH64 hashes of a text's word shingles; a text of fewer words is one shingle."""
    w = (text or b"").lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(s), 42) for s in zip(*(w[i:] for i in range(words)))), np.uint64, len(w) - words + 1))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def minima(s: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(least, (s[at : at + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    flat = least.tobytes()
    step = 8 * ROWS
    keys = np.array([xxhash.xxh64_intdigest(flat[i * step : (i + 1) * step], i) for i in range(BANDS)], dtype=np.uint64)
    return keys.view(np.int64).tolist()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same, keys = [], []
        for t in b.column(1):
            s = shingles(t.as_py())
            same.append(xxhash.xxh128_digest(s.tobytes(), 42))
            keys.append(band_keys(minima(s)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "same", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "s"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, shingles of u, shingles of v): yields (u, v) where the similarity is reached."""
    for b in batches:
        out = []
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
            if similarity(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)) >= LEAST:
                out.append(i)
        at = pa.array(out, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["u", "v"])


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a, c = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "uv")
    return pairs.join(a, "u").join(c, "v").select("u", "v", "su", "sv").mapInArrow(_similar, "u long, v long")


class _Block:
    """Shingle sets of one piece of a band; a set is compared with all of them by looking its shingles up."""

    def __init__(self) -> None:
        self.nodes, self.roots, self.sets, self.above = [], [], [], {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            x = up
        return x

    def file(self, node: int, root: int, s: np.ndarray) -> None:
        self.nodes.append(node)
        self.roots.append(root)
        self.sets.append(s)

    def close(self) -> list[tuple[int, int]]:
        """Links among the filed sets."""
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.shingle, self.owner = every[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        return [link for i in range(1, len(self.sets)) for link in self.ask(self.nodes[i], self.roots[i], self.sets[i], i)]

    def ask(self, node: int, root: int, s: np.ndarray, first: int | None = None) -> list[tuple[int, int]]:
        """Links of a set to the first filed ones, at most one to each group that it was not in."""
        low = np.searchsorted(self.shingle, s, "left")
        n = np.searchsorted(self.shingle, s, "right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sets))
        out = []
        for i in np.flatnonzero((both / (len(s) + self.sizes - both) >= LEAST)[:first]).tolist():
            mine, other = self.root(root), self.root(self.roots[i])
            if mine != other:
                self.above[max(mine, other)] = min(mine, other)
                out.append((max(node, self.nodes[i]), min(node, self.nodes[i])))
        return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block), filed before asking ones: yields links (u, v) that join all groups that link."""
    last, block, closed = None, _Block(), True
    for b in batches:
        links = []
        key, part, asks, node, root = (b.column(i).to_pylist() for i in range(5))
        for i, s in enumerate(b.column(5)):
            if (key[i], part[i]) != last:
                if not closed:
                    links += block.close()
                last, block, closed = (key[i], part[i]), _Block(), False
            own = np.frombuffer(s.as_buffer(), dtype=np.uint64)
            if not asks[i]:
                block.file(node[i], root[i], own.copy())
                continue
            if not closed:
                links += block.close()
                closed = True
            links += block.ask(node[i], root[i], own)
        yield _link_batch(links)
    if not closed:
        yield _link_batch(block.close())


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])


def _all_links(left: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) that join all that link within each key of ``left`` (key, node, root), blocks against themselves and later ones."""
    rows = left.join(sets.select(F.col("id").alias("node"), "s"), "node")
    large = staged(sizes.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "large-bands")
    if large.isEmpty():
        dealt = rows.withColumns({"block": F.lit(0).cast("long"), "asks": F.lit(False)})
    else:
        rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        dealt = rows.withColumn("block", F.explode(F.sequence("own", F.col("blocks") - 1))).withColumn("asks", F.col("block") > F.col("own"))
    dealt = dealt.select("key", "block", "asks", "node", "root", "s").repartition(shuffle_partitions(left.sparkSession), "key", "block")
    return dealt.sortWithinPartitions("key", "block", "asks").mapInArrow(_meet, "u long, v long")


def _alike(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v) of different nodes: each text and the first one of its fingerprint component."""
    found = simhash.classes(rows, "id", "t").where("component_id <> doc_id")
    u, v = (nodes.select(F.col("id").alias(f"id_{x}"), F.col("node").alias(x)) for x in "ab")
    met = found.select(F.col("doc_id").alias("id_a"), F.col("component_id").alias("id_b")).join(u, "id_a").join(v, "id_b")
    return met.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def groups(docs: DataFrame, row: str = "__row", text: str = "text") -> DataFrame:
    """(id, group) for each row of ``docs``, whose ``row`` is a different long for each: rows linked by a similarity of at
    least 0.8 share a group, named by one of its rows. Null text counts as empty; texts without a word are alike.
    """
    rows = docs.select(F.col(row).alias("id"), F.col(text).cast("binary").alias("t"))
    signed = staged(rows.mapInArrow(_signatures, "id long, same binary, keys array<long>"), "signatures")
    nodes = signed.groupBy("same").agg(F.min(F.struct("id", "keys")).alias("m")).select("same", F.col("m.id").alias("node"), "m.keys")
    named = staged(signed.select("id", "same").join(nodes.select("same", "node"), "same").select("id", "node"), "named")
    keyed = signed.join(named.where("id = node").select("id"), "id", "left_semi").select(F.col("id").alias("node"), F.explode("keys").alias("key"))
    keyed = staged(keyed, "bands")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = staged(keyed.join(shared, "key", "left_semi"), "shared-bands")
    size = met.count()
    pairs = staged(_alike(rows, named), "alike")
    candidates = met.select("node").unionByName(pairs.select(F.col("u").alias("node"))).unionByName(pairs.select(F.col("v").alias("node")))
    asked = rows.join(candidates.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    sets = staged(asked.mapInArrow(_sets, "id long, s binary"), "candidate-shingles")
    tested = links = roots = None
    turn, found, whole = 0, size, False
    while True:
        new = staged(_compare(pairs, sets), "similar") if not whole else pairs
        found = new.count()
        if found:
            links = new if links is None else links.unionByName(new)
            roots = staged(components(links).withColumnRenamed("root", "r"), "roots")
        if whole or not size:
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        grouped = met.withColumn("root", F.col("node"))
        if roots is not None:
            grouped = met.join(roots, "node", "left").select("key", "node", F.coalesce("r", "node").alias("root"))
        # One row a (band, group) suffices to see which bands still hold several groups.
        per = grouped.groupBy("key", "root").agg(F.count("*").alias("m"))
        sizes = staged(per.groupBy("key").agg(F.sum("m").alias("n"), F.count("*").alias("roots")).where("roots > 1").select("key", "n"), "open-bands")
        if sizes.isEmpty():
            break
        left = staged(grouped.join(sizes.select("key"), "key", "left_semi"), "open-rows")
        # The links of the fingerprints come first, so there may be none before the first leaders were asked.
        whole = turn >= LEADERS or turn and not found
        if whole:
            pairs = staged(_all_links(left, sizes, sets).distinct(), "links-in-bands")
        else:
            leader = left.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("root").alias("root_b")), F.xxhash64("node", F.lit(turn))).alias("l"))
            pairs = left.join(leader.select("key", "l.b", "l.root_b"), "key").where("root <> root_b")
            pairs = pairs.select(F.greatest("node", "b").alias("u"), F.least("node", "b").alias("v")).distinct()
            pairs = staged(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        turn += 1
    if roots is not None:
        named = named.join(roots, "node", "left").select("id", F.coalesce("r", "node").alias("node"))
    return named.select("id", F.col("node").alias("group"))
