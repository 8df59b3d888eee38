"""A feed read range by range: a data source whose partitions are files of ranges.

Every range is fetched where its file is read. A range that fails is halved until it is short enough to give up,
so one bad day costs a day and not the range around it; what was given up comes back as rows of its own.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.staging import scratch
from ..schema import KEYS, TS

DAY = dt.timedelta(days=1)
#: fetch(key values, start, end) -> rows as (time, *values) with start <= time < end; it raises when it fails.
Fetch = Callable[[tuple, dt.datetime, dt.datetime], Iterable[tuple]]
FAILED = ("failed_start", "failed_end", "error")


def store_of(uri: str):
    """File system and path of a URI; Hadoop's short form file:/x included."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _naive(t) -> dt.datetime:
    """A time read by Arrow as plain UTC."""
    t = t.to_pydatetime() if hasattr(t, "to_pydatetime") else t
    return t.astimezone(dt.timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def _zoned(t: dt.datetime | None) -> dt.datetime | None:
    return None if t is None else t.replace(tzinfo=dt.timezone.utc)


def halves(start: dt.datetime, end: dt.datetime, least: dt.timedelta = DAY) -> tuple | None:
    """The two parts of a range, cut at a full hour; None where it is too short to be cut."""
    if end - start <= least:
        return None
    middle = start + (end - start) / 2
    floor = middle.replace(minute=0, second=0, microsecond=0)
    middle = floor if floor == middle else floor + dt.timedelta(hours=1)
    return ((start, middle), (middle, end)) if start < middle < end else None


def attempts(fetch: Fetch, key: tuple, start: dt.datetime, end: dt.datetime, least: dt.timedelta = DAY) -> Iterator[tuple]:
    """Rows as (time, values..., None, None, None), and (None, ..., start, end, error) for what could not be fetched."""
    stack = [(start, end)]
    while stack:
        a, b = stack.pop()
        try:
            got = [tuple(r) for r in fetch(key, a, b)]
        except Exception as e:  # noqa: BLE001 - whatever a feed raises, the other ranges must go on
            parts = halves(a, b, least)
            if parts is None:
                yield None, a, b, f"{type(e).__name__}: {e}"[:500]
            else:
                stack += reversed(parts)
            continue
        for r in got:
            if r[0] is not None and a <= r[0] < b:
                yield r, None, None, None


@dataclass
class RangeFile(InputPartition):
    uri: str


class RangeReader(DataSourceReader):
    def __init__(self, folder: str, fetch: Fetch, keys: list[str], width: int, least: dt.timedelta):
        self.folder, self.fetch, self.keys, self.width, self.least = folder, fetch, keys, width, least

    def partitions(self) -> list[InputPartition]:
        fs, path = store_of(self.folder)
        scheme = self.folder[: len(self.folder) - len(path)] if self.folder.endswith(path) else ""
        files = fs.get_file_info(pyarrow.fs.FileSelector(path))
        return [RangeFile(scheme + f.path) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".parquet")]

    def read(self, partition: RangeFile) -> Iterator[tuple]:
        fs, path = store_of(partition.uri)
        with fs.open_input_file(path) as raw:
            for batch in pq.ParquetFile(raw).iter_batches(batch_size=256):
                for r in batch.to_pylist():
                    key = tuple(r[k] for k in self.keys)
                    start, end = (_naive(r[c]) for c in ("range_start", "range_end"))
                    for row, a, b, error in attempts(self.fetch, key, start, end, self.least):
                        row = (None,) * self.width if row is None else (_zoned(row[0]), *row[1:])
                        yield (*key, *row, _zoned(a), _zoned(b), error)


def _source(fetch: Fetch, folder: str, rows: T.StructType, keys: list[str], width: int, least: dt.timedelta):
    class RangeFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return "range_feed"

        def schema(self) -> T.StructType:
            return rows

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return RangeReader(folder, fetch, keys, width, least)

    return RangeFeed


def fetch_ranges(
    ranges: DataFrame, fetch: Fetch, values, keys=KEYS, ts: str = TS, least: dt.timedelta = DAY, per_task: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """(rows, failed ranges) of a feed over ``ranges`` (keys, range_start, range_end).

    Ranges are dealt out over files of about ``per_task`` ranges; each file is one partition of the source. The
    result is written once, so no range is asked for twice, and a lost executor repeats its own files only.
    Times are UTC. Ranges with a null bound are not asked for.
    """
    spark, keys, values = ranges.sparkSession, list(keys), list(values)
    asked = ranges.select(*keys, "range_start", "range_end").where("range_start < range_end")
    folder, out = scratch(spark, "asked-ranges"), scratch(spark, "fetched")
    asked.withColumn("_n", F.xxhash64(*keys, "range_start")).sort("_n").drop("_n").write.option("maxRecordsPerFile", per_task).parquet(folder)
    schema = T.StructType(
        [asked.schema[k] for k in keys] + [T.StructField(ts, T.TimestampType())] + [T.StructField(v, T.DoubleType()) for v in values]
        + [T.StructField(FAILED[0], T.TimestampType()), T.StructField(FAILED[1], T.TimestampType()), T.StructField(FAILED[2], T.StringType())]
    )
    spark.dataSource.register(_source(fetch, folder, schema, keys, 1 + len(values), least))
    spark.read.format("range_feed").load().write.parquet(out)
    got = spark.read.schema(schema).parquet(out)
    ok = F.col(FAILED[2]).isNull()
    return got.where(ok).select(*keys, ts, *values), got.where(~ok).select(*keys, *FAILED)


class ParquetFeed:
    """A feed kept as Parquet files partitioned by series; a range reads the folder of its series and its hours only."""

    def __init__(self, uri: str, values, ts: str = TS, key: str = KEYS[0]):
        self.uri, self.values, self.ts, self.key = uri, list(values), ts, key

    def __call__(self, key: tuple, start: dt.datetime, end: dt.datetime) -> Iterator[tuple]:
        import pyarrow as pa
        import pyarrow.dataset as ds

        fs, path = store_of(f"{self.uri}/{self.key}={key[0]}")
        if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return
        data = ds.dataset(path, filesystem=fs, format="parquet")
        at = ds.field(self.ts)
        bound = lambda t: pa.scalar(t.replace(tzinfo=dt.timezone.utc), data.schema.field(self.ts).type)
        for batch in data.to_batches(columns=[self.ts, *self.values], filter=(at >= bound(start)) & (at < bound(end))):
            for r in batch.to_pylist():
                yield (_naive(r[self.ts]), *(r[v] for v in self.values))
