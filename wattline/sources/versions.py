"""A panel published in versions: readers see one version, a batch counts once, a killed write changes nothing.

Data files are never changed. A write puts the months it touches into a new folder and then publishes a manifest
that says, for every month, which folder holds it. The checks run while the rows are written; a panel that breaks
them is not published.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from ..functions.columns import any_of, flag
from ..functions.staging import stage
from ..operators.quality import PanelRules
from ..schema import KEYS, TS, VERSION, ZONE


class Conflict(RuntimeError):
    """Another writer has published a version since the one this write was based on."""


@dataclass
class Manifest:
    version: int = 0
    months: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)
    schema: str | None = None
    metrics: dict = field(default_factory=dict)


class _Files:
    """The few file operations of a manifest, by Hadoop's own file systems, so that any shared store will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def text(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, p: str, text: str) -> None:
        """Write aside, then rename onto a name that must not exist yet."""
        aside = self.path(f"{p}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(p).toUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(self.path(p)), options)
        except Exception as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(p) from e
            raise

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


class VersionedPanel:
    def __init__(self, spark: SparkSession, root: str, keys=KEYS, ts: str = TS, rules: PanelRules = PanelRules()):
        self.spark, self.root, self.keys, self.ts, self.rules = spark, root.rstrip("/"), list(keys), ts, rules
        self.files = _Files(spark, self.root)

    # ------------------------------------------------------------ versions

    def _name(self, version: int) -> str:
        return f"{self.root}/manifest/{version:010d}.json"

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or a given one; an empty one before the first write."""
        if version is None:
            known = self.versions()
            if not known:
                return Manifest()
            version = known[-1]
        return Manifest(**json.loads(self.files.text(self._name(version))))

    def read(self, version: int | None = None, months=None) -> DataFrame | None:
        """One version, whole or some months of it; None before the first write.

        Only the folders of the asked months are listed and read.
        """
        return self._rows(self.manifest(version), months)

    def _rows(self, m: Manifest, months=None) -> DataFrame | None:
        if m.schema is None:
            return None
        wanted = sorted(m.months if months is None else set(months) & set(m.months))
        schema = T.StructType.fromJson(json.loads(m.schema))
        if not wanted:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{m.months[x]}/month={x}" for x in wanted]
        return self.spark.read.schema(schema).parquet(*paths)

    # ------------------------------------------------------------ writes

    def _checks(self, df: DataFrame) -> dict[str, Column]:
        r, no = self.rules, F.lit(False)
        differs = lambda n, v: F.col(n).isNotNull() & (F.col(n) != v) if n in df.columns and v is not None else no
        t = F.col(self.ts)
        within = (t >= F.lit(r.start).cast("timestamp")) & (t <= F.lit(r.end).cast("timestamp")) if r.start and r.end else F.lit(True)
        return {
            "invalid_timestamp": t.isNull(), "duplicate_timestamp": F.col("_again"), "outside_grid": ~within,
            "version_mismatch": differs(VERSION, F.lit(r.version)), "zone_mismatch": differs(ZONE, r.zone_equals),
            "null_required": any_of(F.col(c).isNull() for c in r.required) if r.required else no,
        }

    def _write(self, rows: DataFrame, folder: str) -> tuple[dict, dict]:
        """(metrics, violations) of rows written by month; both are counted on the way to the files."""
        by = ["month", *self.keys]
        out = rows.withColumn("month", F.coalesce(F.date_format(self.ts, "yyyy-MM"), F.lit("none")))
        out = out.repartitionByRange(*by).sortWithinPartitions(*by, self.ts)
        before = F.lag(self.ts).over(Window.partitionBy(*by).orderBy(self.ts))
        out = out.withColumn("_again", flag(before == F.col(self.ts)))
        checks = self._checks(rows.withColumn("_again", F.lit(False)))
        seen = Observation("panel")
        nulls = [c for c in rows.columns if c not in (*self.keys, self.ts)]
        metrics = [F.count(F.lit(1)).alias("rows"), F.min(self.ts).cast("string").alias("first"), F.max(self.ts).cast("string").alias("last")]
        metrics += [F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(nulls)]
        metrics += [F.count_if(flag(cond)).alias(f"rule_{n}") for n, cond in checks.items()]
        out.observe(seen, *metrics).drop("_again").write.partitionBy("month").parquet(f"{self.root}/{folder}")
        got = seen.get
        return (
            {"rows": got["rows"], "first": got["first"], "last": got["last"], "nulls": {c: got[f"null_{i}"] for i, c in enumerate(nulls)}},
            {n: got[f"rule_{n}"] for n in checks},
        )

    def replace(self, rows: DataFrame, base: Manifest, months, applied: dict[str, int] | None = None) -> Manifest:
        """Publish a version based on ``base`` in which ``months`` hold ``rows``; a month without rows is dropped.

        Raises ValueError on broken rules and Conflict where another version came first; the old one stays then.
        """
        folder = f"data/{uuid.uuid4().hex}"
        metrics, violations = self._write(rows, folder)
        broken = {k: n for k, n in violations.items() if n}
        if broken:
            self.files.delete(f"{self.root}/{folder}")
            raise ValueError("panel failed validation: " + ", ".join(f"{k}={n}" for k, n in sorted(broken.items())))
        written = {n.removeprefix("month=") for n in self.files.names(f"{self.root}/{folder}") if n.startswith("month=")}
        kept = {m: f for m, f in base.months.items() if m not in set(months)}
        new = Manifest(base.version + 1, kept | {m: folder for m in written}, base.applied | (applied or {}), json.dumps(rows.schema.jsonValue()), metrics)
        self.files.publish(self._name(new.version), json.dumps(vars(new)))
        return new

    def merge(
        self, batch: DataFrame, combine: Callable[[DataFrame], DataFrame], sink: str = "batch", batch_id: int | None = None, retries: int = 3,
    ) -> Manifest:
        """Combine ``batch`` with the months it touches: ``combine`` gets the old rows of these months and the batch.

        With a ``batch_id`` a batch that ``sink`` has already applied changes nothing, also when its first attempt
        was killed after it had published. A write that another one overtook starts again from the newer version.
        """
        batch = stage(batch)
        month = F.coalesce(F.date_format(self.ts, "yyyy-MM"), F.lit("none"))
        months = [r["m"] for r in batch.select(month.alias("m")).distinct().collect()]  # months, however many the rows
        for attempt in range(retries + 1):
            base = self.manifest()
            if batch_id is not None and base.applied.get(sink, -1) >= batch_id:
                return base
            if not months:
                return base
            old = self._rows(base, months)
            both = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
            try:
                return self.replace(combine(both), base, months, {} if batch_id is None else {sink: batch_id})
            except Conflict:
                if attempt == retries:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete data that none of the last ``keep`` versions holds, and the older manifests. No write may be running."""
        known = self.versions()
        held = {f for v in known[-keep:] for f in self.manifest(v).months.values()}
        gone = [f"data/{n}" for n in self.files.names(f"{self.root}/data") if f"data/{n}" not in held]
        for name in gone:
            self.files.delete(f"{self.root}/{name}")
        for v in known[:-keep]:
            self.files.delete(self._name(v))
        return gone
