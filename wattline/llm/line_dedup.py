"""Line deduplication against levelled sorted runs of line hashes.

The index is a set of runs, each a table bucketed and sorted by line key, with the smallest document
that holds the line. A batch of documents is compared with all runs by merge joins; keys that no run holds
become a new run of level 0. When a level has ``fanout`` runs they are merged into one of the next level,
so a key is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import NULL_ID, new_path, shuffle_partitions, staged

MIN_CHARS = 10
BATCHES, FANOUT = 4, 2


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def counts_as_key(key: bytes, min_chars: int) -> bool:
    return (len(key) if key.isascii() else len(key.decode())) >= min_chars


class LineRuns:
    """Runs (key, first_id) with disjoint keys. ``levels[i]`` lists the tables of level i, oldest first."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.path}/run-{self.written}"
        table = "lines_" + hashlib.md5(path.encode()).hexdigest()
        self.written += 1
        dealt = rows.select("key", "first_id").repartition(self.buckets, "key")
        dealt.write.option("path", path).bucketBy(self.buckets, "key").sortBy("key").format("parquet").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def compact(self) -> None:
        """Merge every full level into one run of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                self.levels[level] = []
                self._write(reduce(DataFrame.unionByName, [self.spark.read.table(t) for t in old]), level + 1)
            level += 1

    def runs(self) -> list[DataFrame]:
        return [self.spark.read.table(t) for level in self.levels for t in level]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, ...) with seen_id, the document under which a run holds the key, or null."""
        found = []
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.select("key", F.col("first_id").alias(f"s{i}")).hint("merge"), "key", "left")
            found.append(f"s{i}")
        seen = F.coalesce(*[F.col(c) for c in found]) if found else F.lit(None).cast("long")
        return keys.withColumn("seen_id", seen).drop(*found)

    def add(self, keys: DataFrame) -> None:
        """Anti-join (key, first_id) with all runs; the rest becomes a run of level 0."""
        for run in self.runs():
            keys = keys.join(run.hint("merge"), "key", "left_anti")
        self._write(keys, 0)


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, key): each document's different line keys of at least ``min_chars`` code points, as 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                for key in {line_key(x) for x in (t.as_py() or b"").split(b"\n")}:
                    if counts_as_key(key, min_chars):
                        ids.append(d)
                        keys.append(xxhash.xxh3_128_digest(key))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])

    return docs.select("id", "t").mapInArrow(run, "id long, key binary")


def _rewrite(rows: DataFrame, min_chars: int, with_text: bool) -> DataFrame:
    """Drop the lines whose key is listed in ``drop``; rows are (doc_id, t, drop)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[], [], [], []]
            for t, drop in zip(b.column(1), b.column(2).to_pylist()):
                lines, gone = (t.as_py() or b"").split(b"\n"), set(drop or ())
                kept = lines
                if gone:
                    keys = [line_key(x) for x in lines]
                    kept = [x for x, k in zip(lines, keys) if not (counts_as_key(k, min_chars) and xxhash.xxh3_128_digest(k) in gone)]
                text = b"\n".join(kept)
                for c, v in zip(cols, (len(lines), len(lines) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None)):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [b.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"
    return rows.select("doc_id", "t", "drop").mapInArrow(run, schema)


def dedupe_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
    batches: int = BATCHES, fanout: int = FANOUT, with_text: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256, kept_text (null unless ``with_text``).

    Lines end at \\n; null or empty text is one empty line. A line's key is the line without white space
    at its ends, A-Z lower-cased. A key of at least ``min_chars`` code points loses all its lines but those
    of the smallest doc_id that holds it. Documents enter the runs in ``batches`` ranges of ascending doc_id, so
    that the runs always hold smaller ids. Rows with equal doc_id count as one document; rows without
    doc_id as one last document. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID)))
    cuts = sorted(set(rows.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)])).first()[0] or [])) if batches > 1 else []
    runs = LineRuns(spark, new_path(spark, "line-runs"), fanout)
    drops = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.where(F.col("id") > low)
        part = part if high is None else part.where(F.col("id") <= high)
        keys = staged(_keys(part, min_chars), "line-keys")
        runs.compact()
        firsts = keys.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        known = staged(runs.lookup(firsts), "line-firsts")
        runs.add(known.where("seen_id IS NULL").select("key", "first_id"))
        repeated = known.where("n > 1 OR seen_id IS NOT NULL").select("key", F.least("first_id", "seen_id").alias("first_id"))
        drops.append(keys.join(repeated, "key").where("first_id < id").select("id", "key"))
    dropped = reduce(DataFrame.unionByName, drops).groupBy("id").agg(F.collect_set("key").alias("drop"))
    return _rewrite(rows.join(staged(dropped, "line-drops"), "id", "left"), min_chars, with_text)


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), marked AS (
  SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
