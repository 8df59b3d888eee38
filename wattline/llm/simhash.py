"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Two 64-bit fingerprints that differ in at most three bits are cut into three segments of 23, 23 and 18
bits. By the pigeonhole principle two of the three segments differ in at most one bit each. Each segment
is decoded to Golay codeword indices: one for the segment itself, and up to six for the segment and its
one-bit neighbours. A fingerprint is filed under the index pair of each of the three segment pairs, and
looked up under all index pairs of its neighbours; what meets under a key is compared in full. All links
are found, none is guessed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import shuffle_partitions, staged
from .components import components
from .golay import decoder, near_indices

SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_BITS = 3
#: Fingerprints filed under one key that are compared in one piece; larger keys are split into such blocks.
BLOCK = 4096
SMALL = 32


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Bitwise majority of the XXH64 hashes of a text's word shingles, repeats included."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), seed) for s in zip(*(w[i:] for i in range(words)))), np.uint64, len(w) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; null text counts as empty, which has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def segments(fps: np.ndarray) -> list[np.ndarray]:
    return [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int32) for at, width in SEGMENTS]


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = decoder()
    for b in batches:
        own = [table[p].astype(np.int32) for p in segments(b.column(0).to_numpy().view(np.uint64))]
        for k, (i, j) in enumerate(PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array(k << 24 | own[i] << 12 | own[j])], ["key"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint the three keys it is filed under (asks false) and all keys it asks for."""
    table = decoder()
    for b in batches:
        signed = b.column(0).to_numpy()
        for at in range(0, len(signed), 2000):
            fps = signed[at : at + 2000]
            parts = segments(fps.view(np.uint64))
            own = [table[p].astype(np.int32) for p in parts]
            near = [near_indices(p, width) for p, (_, width) in zip(parts, SEGMENTS)]
            for k, (i, j) in enumerate(PAIRS):
                filed = k << 24 | own[i] << 12 | own[j]
                a, c = near[i][:, :, None], near[j][:, None, :]
                asked = np.where((a >= 0) & (c >= 0), k << 24 | a << 12 | c, -1).reshape(len(fps), -1)
                row, col = np.nonzero(asked >= 0)
                key = np.concatenate([filed, asked[row, col]])
                out = [pa.array(key.astype(np.int32)), pa.array(np.concatenate([fps, fps[row]])), pa.array(np.arange(len(key)) >= len(fps))]
                yield pa.RecordBatch.from_arrays(out, ["key", "fp", "asks"])


def _spanning(asking: np.ndarray, filed: np.ndarray) -> list[tuple[int, int]]:
    """True links that join the same rows as all links between ``asking`` and ``filed``, at most one a row of either."""
    parent = list(range(len(filed)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for q in asking:
        hits = np.flatnonzero(np.bitwise_count(filed ^ q) <= MAX_BITS)
        joined: set[int] = set()
        for h in hits.tolist():
            r = root(h)
            if r not in joined:
                joined.add(r)
                if filed[h] != q:
                    out.append((int(q), int(filed[h])))
        if len(joined) > 1:
            first, *rest = joined
            for r in rest:
                parent[r] = first
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, filed fingerprints before asking ones: yields true links (u, v)."""
    last, held = None, np.zeros(0, dtype=np.uint64)
    for b in batches:
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        asks = b.column(2).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        if last is None or key[0] != last:
            held = held[:0]
        file_key = np.concatenate([np.full(len(held), key[0]), key[~asks]])
        file_fp = np.concatenate([held, fp[~asks]])
        ask_key, ask_fp = key[asks], fp[asks]
        low, high = np.searchsorted(file_key, ask_key, "left"), np.searchsorted(file_key, ask_key, "right")
        n = high - low
        u, v = [], []
        few = np.flatnonzero((n > 0) & (n <= SMALL))
        reps = n[few]
        at = np.repeat(low[few] - np.concatenate([[0], np.cumsum(reps)[:-1]]) if len(few) else low[few], reps) + np.arange(reps.sum())
        x, y = np.repeat(ask_fp[few], reps), file_fp[at.astype(np.int64)]
        near = (np.bitwise_count(x ^ y) <= MAX_BITS) & (x > y)
        u.append(x[near])
        v.append(y[near])
        many = np.flatnonzero(n > SMALL)
        for start in np.unique(low[many]):
            rows = many[low[many] == start]
            links = _spanning(ask_fp[rows], file_fp[start : high[rows[0]]])
            u.append(np.array([p for p, _ in links], dtype=np.uint64))
            v.append(np.array([p for _, p in links], dtype=np.uint64))
        last = key[-1]
        held = file_fp[file_key == last]
        u, v = np.concatenate(u), np.concatenate(v)
        if len(u):
            both = np.unique(np.stack([u, v], axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["u", "v"])


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v) pairs of different fingerprints in ``distinct`` (fp) at three or fewer bits, enough to join all that link.

    A key under which more than ``block`` fingerprints are filed is dealt out in blocks, and what asks
    for it goes to each of them, so no task holds more than one block. Within a block links are
    returned as a spanning forest, never as all pairs.
    """
    spark = distinct.sparkSession
    keyed = distinct.select("fp").mapInArrow(_keys, "key int, fp long, asks boolean")
    keyed = keyed.withColumn("key", F.col("key").cast("long") * F.lit(1 << 24))
    filed = distinct.select("fp").mapInArrow(_filed, "key int")
    counts = filed.groupBy((F.col("key").cast("long") * F.lit(1 << 24)).alias("key")).agg(F.count("*").alias("n"))
    large = counts.where(F.col("n") > block)
    large = staged(large.select("key", F.ceil(F.col("n") / block).alias("blocks")), "large-keys")
    if not large.isEmpty():
        keyed = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        mine = F.array(F.pmod(F.xxhash64("fp"), "blocks"))
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        keyed = keyed.withColumn("b", F.explode(F.when(F.col("asks"), every).otherwise(mine)))
        keyed = keyed.select((F.col("key") + F.col("b")).alias("key"), "fp", "asks")
    dealt = keyed.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "asks")
    return dealt.mapInArrow(_meet, "u long, v long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at three or fewer differing bits; component_id is the smallest doc_id reachable
    over links, itself included. Equal fingerprints are compared once. Null text counts as empty, texts
    without a word have fingerprint zero and link like any other. Rows without doc_id are fingerprinted
    and linked, but never name a component unless all of its rows lack one (then null). Repeated rows
    stay repeated. Other columns are ignored; an empty table gives no rows.
    """
    rows = staged(fingerprints(docs, doc_id, text, words), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
