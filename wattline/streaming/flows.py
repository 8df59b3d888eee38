"""Streaming queries; each has the batch operator it must agree with."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import maps
from ..functions.staging import stage
from ..operators import quality
from ..schema import KEYS, TS
from ..sources.storage import event_json
from ..sources.versions import VersionedPanel


def hourly_rollup(stream: DataFrame, cols, keys=KEYS, ts: str = TS, delay: str = "2 hours") -> DataFrame:
    """Mean per hour, emitted once the watermark passes the hour. ``ts`` must be TIMESTAMP, not TIMESTAMP_NTZ."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, "1 hour").alias("_w"))
        .agg(*[F.avg(c).alias(c) for c in cols])
        .select(*keys, F.col("_w.start").alias(ts), *cols)
    )


def dedupe(stream: DataFrame, keys=KEYS, ts: str = TS, delay: str = "2 hours") -> DataFrame:
    """First arrival per (series, time); state is kept only within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def sliding_features(stream: DataFrame, value: str, keys=KEYS, ts: str = TS, delay: str = "2 hours") -> DataFrame:
    """Mean and deviation of the last 24 hours, every hour."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, "24 hours", "1 hour").alias("_w"))
        .agg(
            F.avg(value).alias(f"{value}_mean_24h"),
            F.stddev_samp(value).alias(f"{value}_std_24h"),
            F.count(value).alias("n"),
        )
        .select(*keys, F.col("_w.end").alias(ts), f"{value}_mean_24h", f"{value}_std_24h", "n")
    )


@dataclass(frozen=True)
class PositionSettings:
    max_change: float
    limit: float
    notional: float
    execution_delay: bool = True
    delay_seconds: int = 0
    idle_seconds: int | None = None
    keys: tuple = KEYS
    ts: str = TS
    target: str = "target_position"
    price: str = "price_eur_mwh"
    exposure: str = "exposure_mwh"


class Positions:
    """Position ramp and gross equity of one series, kept between batches.

    Rows wait in the state until the newest row of their own series is ``delay_seconds`` ahead, then they are folded
    in order of time. A row not later than the last one folded is late. With ``idle_seconds`` a timeout folds what
    still waits when a series has been silent for so long; such a stream never ends by itself, as Spark goes on
    running batches to look for timeouts, so leave it out where all available input is read once.
    """

    STATE = (
        "last_price double, before double, position double, equity double, seen long, waiting binary"
    )
    FLOOR, CAP, ROWS = 1e-6, 1.0 - 1e-6, 5000

    def __init__(self, settings: PositionSettings):
        self.s = settings

    def _load(self, state: GroupState) -> tuple[list, np.ndarray]:
        """(last price, position before, position, equity, last time) and the waiting rows (time, target, price, size)."""
        if not state.exists:
            return [None, 0.0, 0.0, max(self.s.notional, 1.0), None], np.empty((0, 4))
        *now, waiting = state.get
        return now, np.frombuffer(bytes(waiting), dtype=float).reshape(-1, 4)

    def _store(self, state: GroupState, now: list, waiting: np.ndarray) -> None:
        state.update((*now, bytearray(np.ascontiguousarray(waiting, dtype=float).tobytes())))
        if len(waiting) and self.s.idle_seconds:
            state.setTimeoutDuration(self.s.idle_seconds * 1000)

    def __call__(self, key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = self.s
        now, waiting = self._load(state)
        if state.hasTimedOut:
            yield from self._fold(key, now, waiting)
            self._store(state, now, waiting[:0])
            return
        parts = [waiting]
        for pdf in batches:  # one after the other; only its numbers are kept
            t = pdf[s.ts].to_numpy().astype("datetime64[us]").astype(np.int64)
            late = t <= now[4] if now[4] is not None else np.zeros(len(t), bool)
            if late.any():
                yield self._frame(key, t[late], np.full(late.sum(), np.nan), np.full(late.sum(), np.nan), True)
            parts.append(np.column_stack([t, *[pdf[c].to_numpy(dtype=float) for c in (s.target, s.price, s.exposure)]])[~late])
        waiting = np.concatenate(parts)
        if len(waiting):
            ready = waiting[:, 0] <= waiting[:, 0].max() - s.delay_seconds * 1_000_000
            yield from self._fold(key, now, waiting[ready])
            waiting = waiting[~ready]
        self._store(state, now, waiting)

    def _fold(self, key, now: list, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        s = self.s
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        for first in range(0, len(rows), self.ROWS):
            part = rows[first : first + self.ROWS]
            positions, equities = np.empty(len(part)), np.empty(len(part))
            last, before, position, equity, seen = now
            for i, (at, wanted, p, size) in enumerate(part.tolist()):
                held = before if s.execution_delay else position
                if last is not None and p == p and size == size:
                    equity, _ = maps.equity_step(equity, held * (p - last) * size, self.FLOOR, self.CAP)
                wanted = 0.0 if wanted != wanted else wanted
                before, position = position, maps.ramp_step(position, wanted, s.max_change, s.limit)
                last, seen = (None if p != p else p), int(at)
                positions[i], equities[i] = position, equity
            now[:] = [last, before, position, equity, seen]
            yield self._frame(key, part[:, 0].astype(np.int64), positions, equities, False)

    def _frame(self, key, at: np.ndarray, position: np.ndarray, equity: np.ndarray, late: bool) -> pd.DataFrame:
        times = pd.to_datetime(at.astype("datetime64[us]"))
        table = pd.DataFrame({self.s.ts: times, "position_after": position, "gross_equity_eur": equity, "late": late})
        for name, value in zip(reversed(self.s.keys), reversed(key)):
            table.insert(0, name, value)
        return table


def position_states(stream: DataFrame, settings: PositionSettings) -> DataFrame:
    """Position after every row and gross equity, per series across batches, with ``late`` for rows that came too late.

    Late rows are not folded in: write them to a side table (:func:`split_late`). A price move earns on the position
    held over it: with execution delay, the one reached a row before the move began. Costs are left out. A null
    target counts as 0; a null price earns nothing. What is in a task at once are the numbers of one series' rows of
    one batch; the source's batch size bounds them.
    """
    ddl = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in settings.keys)
    fold = Positions(settings)
    return stream.groupBy(*settings.keys).applyInPandasWithState(
        lambda key, batches, state: fold(key, batches, state),
        f"{ddl}, {settings.ts} timestamp, position_after double, gross_equity_eur double, late boolean",
        Positions.STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if settings.idle_seconds else GroupStateTimeout.NoTimeout,
    )


def split_late(path: str, late_path: str, keys=KEYS, ts: str = TS):
    """foreachBatch function: positions to one folder per batch, late rows to another; a repeated batch replaces its own."""

    def write(batch: DataFrame, i: int) -> None:
        rows = stage(batch)
        rows.where("NOT late").drop("late").write.mode("overwrite").parquet(f"{path}/batch={i}")
        rows.where("late").select(*keys, ts).write.mode("overwrite").parquet(f"{late_path}/batch={i}")

    return write


def upsert_sink(panel: VersionedPanel, sink: str = "stream", tie_break=None):
    """foreachBatch function: merge a batch into the panel by quality and publish it as one version.

    Only the months of the batch are read and written. A batch that comes twice changes nothing, and a batch that is
    killed leaves the version before it.
    """

    def write(batch: DataFrame, i: int) -> None:
        panel.merge(batch, lambda df: quality.upsert_by_quality(df, panel.keys, panel.ts, tie_break), sink, i)

    return write


def decision_log(events: DataFrame, path: str, checkpoint: str):
    """Append each event as one JSON line, exactly once per checkpoint."""
    return (
        event_json(events)
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
