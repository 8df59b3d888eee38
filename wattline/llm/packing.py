"""Hierarchical packing of documents into windows of several context sizes.

Each task tokenises its documents and packs them in blocks. Documents are cut to the longest window,
every piece is routed to the smallest tier that holds it, and tiers are packed from long to short:
a piece opens a window of its tier, and gaps are filled by the longest shorter pieces that fit. Where
none fits, the shortest piece that covers the gap is cut. All windows are full; the last rest of a block is cut
at powers of two. Sequences are then dealt to step groups of nearly equal tokens. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tokens import EncoderCache

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens that a task packs together, and tokens of a step group.
BLOCK_TOKENS, STEP_TOKENS = 1 << 20, 1 << 14
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class Pool:
    """Pieces (document, start) by length; a bit mask tells which lengths are there."""

    def __init__(self, longest: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.mask, self.tokens = 0, 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.by_length[length].append((doc, start))
        self.mask |= 1 << length
        self.tokens += length

    def take(self, length: int) -> tuple[int, int]:
        found = self.by_length[length].pop()
        if not self.by_length[length]:
            self.mask ^= 1 << length
        self.tokens -= length
        return found

    def longest(self, at_most: int) -> int:
        """Length of the longest piece up to ``at_most``, 0 if none."""
        return max(0, (self.mask & ((1 << (at_most + 1)) - 1)).bit_length() - 1)

    def shortest(self, above: int) -> int:
        """Length of the shortest piece longer than ``above``, 0 if none."""
        rest = self.mask >> (above + 1)
        return above + (rest & -rest).bit_length() if rest else 0


def _fill(pool: Pool, window: int, first: int) -> list[tuple[int, int, int]]:
    """One full window as (document, start, length): the piece of length ``first``, then the longest that fit."""
    pieces, gap = [(*pool.take(first), first)], window - first
    while gap:
        n = pool.longest(gap)
        if n:
            pieces.append((*pool.take(n), n))
        else:
            n = pool.shortest(gap)
            doc, start = pool.take(n)
            pieces.append((doc, start, gap))
            pool.put(doc, start + gap, n - gap)
            n = gap
        gap -= n
    return pieces


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces; every token of every document is in exactly one piece.

    Every sequence is exactly as long as a tier, or another power of two for the last few of the rest.
    """
    longest = tiers[0]
    pool, out = Pool(longest), []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % longest, longest):
            out.append([(doc, start, longest)])
        if n % longest:
            pool.put(doc, n - n % longest, n % longest)
    for tier in tiers:
        shorter = tier // 2 if tier != tiers[-1] else 0
        while pool.tokens >= tier and (n := pool.longest(tier)) > shorter:
            out.append(_fill(pool, tier, n))
    size = longest
    while pool.tokens:
        size = min(size, 1 << (pool.tokens.bit_length() - 1))
        n = pool.longest(size) or pool.shortest(size)
        if n > size:
            doc, start = pool.take(n)
            pool.put(doc, start + size, n - size)
            out.append([(doc, start, size)])
        else:
            out.append(_fill(pool, size, n))
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: longest first, always to the group with the fewest tokens."""
    groups = max(1, round(sum(sizes) / step_tokens))
    load, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, g = heapq.heappop(load)
        out[i] = g
        heapq.heappush(load, (tokens + sizes[i], g))
    return out


def _packed(docs: list[tuple], tiers: tuple[int, ...], step_tokens: int, first: int) -> pa.RecordBatch:
    """Pieces of a block of (doc_id, ids); sequence numbers start at ``first``."""
    sequences = pack([len(ids) for _, ids in docs], tiers)
    groups = step_groups([sum(p[2] for p in s) for s in sequences], step_tokens)
    order = sorted(range(len(sequences)), key=groups.__getitem__)
    rows = []
    for k, i in enumerate(order):
        at, total = 0, sum(p[2] for p in sequences[i])
        for doc, start, n in sequences[i]:
            doc_id, ids = docs[doc]
            rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), first + k, at, total, first + groups[i]))
            at += n
    cols = list(zip(*rows)) or [[] for _ in range(9)]
    kinds = [pa.int32() if k == 7 else pa.int64() for k in range(9)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def pack_documents(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document is its ids by the tokenizer file ``tokenizer``, then id 1; null text counts as empty and
    is one id. Whole texts are encoded, however long. tier is the length of the piece's sequence: a tier,
    or for the rest of a block another power of two, so nothing is padded. Rows without doc_id are packed
    with a null doc_id; repeated rows are packed each. sequence_id and step_group are unique, not gapless:
    task number times 2^33 plus a number within the task. The layout follows the partitions of ``docs``; a lost task
    gives the same rows when it runs again. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = EncoderCache.of(tokenizer)
        first, held, tokens = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.ids(t.as_py() or b"", END_ID)
                held.append((d, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    out = _packed(held, tiers, step_tokens, first)
                    first, held, tokens = first + tokens, [], 0
                    yield out
        if held:
            yield _packed(held, tiers, step_tokens, first)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, SCHEMA)
