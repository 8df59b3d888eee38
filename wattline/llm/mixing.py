"""Mixing sources to target weights by cube-method balanced sampling.

A source taken at rate r gives every document floor(r) whole copies and a fractional inclusion
probability. The cube method moves the vector of probabilities along the null space of the balancing
constraints (document count and token total) until every entry but a few is 0 or 1. It runs in blocks
of documents; what a block leaves undecided meets again in blocks of blocks, until one small landing
problem per source remains, which is solved by trying all its outcomes.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import row_index, staged

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents per block of the first flight, blocks whose leftovers meet in the next, documents left to the landing.
BLOCK, FAN, LANDING = 4096, 512, 10
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, rank, source_size, n, target): ``share`` of all sizes dealt by weight, at most ``cap`` times a source's own.

    ``sizes`` has (source, size). Sources by code point, null last, weigh ``weights``, repeating. What a
    source cannot take is dealt again among the rest by weight, until none is above its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = row_index(per, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.withColumns({"w": weight, "most": F.col("source_size") * cap}), "sources")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    per_weight = 0.0
    while True:
        full = F.col("most") <= F.col("w") * per_weight
        taken, open_weight = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w")))).first()
        now = max(0.0, total - (taken or 0.0)) / open_weight if open_weight else per_weight
        if now <= per_weight:
            break
        per_weight = now
    return ranked.select("source", "rank", "source_size", "n", F.least(F.col("w") * per_weight, F.col("most")).alias("target"))


def _direction(a: tuple, b: tuple, c: tuple) -> tuple[float, float, float]:
    """A vector along which three probabilities move without changing either balancing total."""
    (a1, a2), (b1, b2), (c1, c2) = a, b, c
    u = (b1 * c2 - c1 * b2, c1 * a2 - a1 * c2, a1 * b2 - b1 * a2)
    return u if any(abs(x) > 1e-9 for x in u) else (1.0 / a1, -1.0 / b1, 0.0)


def _flight(pi: list[float], rows: list[tuple[float, float]], draw: random.Random, leave: int) -> list[float]:
    """Fast flight over documents in the given order; at most ``max(leave, 2)`` entries stay fractional."""
    pi = list(pi)
    todo = [i for i, p in enumerate(pi) if 1e-9 < p < 1 - 1e-9]
    at, active, left = 0, [], len(todo)
    while left > max(leave, 2):
        while len(active) < 3:
            active.append(todo[at])
            at += 1
        u = _direction(*(rows[i] for i in active))
        up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in zip(active, u) if abs(x) > 1e-12)
        down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in zip(active, u) if abs(x) > 1e-12)
        step = up if draw.random() * (up + down) < down else -down
        for i, x in zip(active, u):
            p = pi[i] + step * x
            pi[i] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
        undecided = [i for i in active if 0.0 < pi[i] < 1.0]
        left -= 3 - len(undecided)
        active = undecided
    return pi


def _order(sizes: list[int], leave: int) -> list[int]:
    """Positions of documents sorted by size as they enter the flight: ``leave`` of all sizes stay for last."""
    n = len(sizes)
    late = {round(i * (n - 1) / max(1, leave - 1)) for i in range(leave)} if n else set()
    return [i for i in range(n) if i not in late] + sorted(late)


def _land(pi: list[float], sizes: list[int]) -> list[float]:
    """The outcome of the undecided entries whose token total, and with little weight count, is nearest."""
    open_ = [i for i, p in enumerate(pi) if 0.0 < p < 1.0]
    size, p = np.array([sizes[i] for i in open_], dtype=float), np.array([pi[i] for i in open_])
    picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(float)
    miss = np.abs(picks @ size - p @ size) / max(1.0, size.mean() if len(size) else 1.0) + 0.02 * np.abs(picks.sum(axis=1) - p.sum())
    pi = list(pi)
    for i, x in zip(open_, picks[miss.argmin()]):
        pi[i] = float(x)
    return pi


def _flown(units: DataFrame, last: bool, level: int) -> DataFrame:
    """One flight in every block; the last one also lands."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fly(pdf, last, level)

    return units.groupBy("rank", "block").applyInPandas(fly, units.schema)


def _fly(pdf: pd.DataFrame, last: bool, level: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable")
    if last:
        undecided = np.flatnonzero((pdf["pi"] > 1e-9) & (pdf["pi"] < 1 - 1e-9))
        pdf = pdf.iloc[undecided[_order(undecided.tolist(), LANDING)].tolist() + np.setdiff1d(np.arange(len(pdf)), undecided).tolist()]
    sizes, start = pdf["size"].tolist(), pdf["start"].tolist()
    rows = [(1.0 / max(p, 1e-9), s / max(p, 1e-9)) for p, s in zip(start, sizes)]
    draw = random.Random(f"{level}/{pdf['rank'].iloc[0]}/{pdf['block'].iloc[0]}")
    pi = _flight(pdf["pi"].tolist(), rows, draw, LANDING + 2 if last else 2)
    return pdf.assign(pi=_land(pi, sizes) if last else pi)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, row: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, size, source, source_size, target, copies, taken.

    ``row`` names a column that numbers the rows, handed through as row (else null).
    size counts words (null text: 0). copies is how often the document is taken, at most ceil of its
    source's rate and so never above ``cap``; taken = copies * size. Null sources form one source, last in
    order. Empty documents of a source with words follow its rate. A source without words has target 0 and
    is not taken. Random draws depend only on sizes, texts and ids, so reruns and other partitionings
    agree; repeated rows are separate documents. Other columns are ignored; an empty table gives no rows.
    """
    sized = staged(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
            n_words(F.col(text)).alias("size"), F.xxhash64(text, doc_id).alias("h"),
            (F.col(row) if row else F.lit(None)).cast("long").alias("row"),
        ),
        "sizes",
    )
    per = staged(targets(sized, share, cap, weights), "targets")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    per = per.withColumns({"rate": rate, "blocks": F.ceil(F.col("n") / BLOCK)})
    units = sized.join(per.select(F.col("source").alias("s"), "rank", "source_size", "target", "rate", "blocks"), F.col("source").eqNullSafe(F.col("s")))
    whole = F.floor(F.col("rate") + 1e-12)
    units = units.withColumns(
        {"whole": whole, "start": F.greatest(F.lit(0.0), F.col("rate") - whole), "block": F.pmod("h", "blocks")}
    ).withColumn("pi", F.col("start"))
    units = staged(units.select("row", "doc_id", "source", "size", "h", "rank", "source_size", "target", "whole", "start", "pi", "block"), "units")
    blocks = per.agg(F.max("blocks")).first()[0] or 1
    open_, done, level = units, [], 0
    while True:
        last = blocks <= 1
        flown = staged(_flown(open_, last, level), "flight")
        if last:
            done.append(flown)
            break
        undecided = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(flown.where(~undecided))
        open_ = flown.where(undecided).withColumn("block", F.floor(F.col("block") / FAN))
        blocks, level = -(-blocks // FAN), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("whole") + F.round("pi")).cast("long")
    return out.select("row", "doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
