"""A table of sorted runs that is read, merged and edited while it grows.

A run is a folder of Parquet files sorted by bucket, a hash of the key.  A
snapshot is a small file that names the runs of one version; it is never
changed, and a new one takes effect when its file appears.  Runs of a level
merge into one run of the next, so a table of n batches has some log n runs.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import children, create_text, read_text, remove

FAN = 8  # runs of a level that make one of the next
BUCKETS = 1024
KEPT_SNAPSHOTS = 16
SNAPSHOTS = "_snapshots"


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    rows: int
    without: tuple[int, ...] = ()  # buckets that a later run has in its place


@dataclass(frozen=True)
class Snapshot:
    version: int
    runs: tuple[Run, ...] = ()
    last_batch: int = -1
    schema: str | None = None  # as JSON


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


# ------------------------------------------------------------------- snapshots

def _file(path: str, version: int) -> str:
    return f"{path}/{SNAPSHOTS}/{version:020d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(name.removesuffix(".json")) for name in children(spark, f"{path}/{SNAPSHOTS}") if name.endswith(".json")]


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest snapshot, or the one of a version; batch folders without any are taken for runs as they are."""
    if version is None:
        known = versions(spark, path)
        if not known:
            found = [n for n in children(spark, path) if n.startswith("batch=")]
            ids = [int(n.removeprefix("batch=")) for n in found]
            return Snapshot(0, tuple(Run(n, 0, 0) for n in found), max(ids, default=-1))
        version = known[-1]
    content = json.loads(read_text(spark, _file(path, version)))
    runs = tuple(Run(**{**r, "without": tuple(r["without"])}) for r in content.pop("runs"))
    return Snapshot(**content, runs=runs)


def commit(spark: SparkSession, path: str, change: Callable[[Snapshot], Snapshot | None]) -> Snapshot:
    """Make what ``change`` makes of the newest snapshot the next one; ``None`` leaves it.

    Of two writers one is first; the other applies its change to what that one has made.
    """
    while True:
        now = snapshot(spark, path)
        made = change(now)
        if made is None:
            return now
        made = replace(made, version=now.version + 1)
        if create_text(spark, _file(path, made.version), json.dumps(asdict(made))):
            return made


def vacuum(spark: SparkSession, path: str, keep: int = KEPT_SNAPSHOTS) -> None:
    """Delete runs that only snapshots before the last ``keep`` name, and those snapshots.

    Runs that no snapshot names yet are left to those who write them.
    """
    known = versions(spark, path)
    if len(known) <= keep:
        return
    needed = {run.name for v in known[-keep:] for run in snapshot(spark, path, v).runs}
    for version in known[:-keep]:
        for run in snapshot(spark, path, version).runs:
            if run.name not in needed:
                remove(spark, f"{path}/{run.name}")
    for version in known[:-keep]:
        remove(spark, _file(path, version))


# ----------------------------------------------------------------------- runs

def run_rows(spark: SparkSession, path: str, runs: Sequence[Run], schema: str | None) -> DataFrame:
    """All rows of runs, with ``bucket``, less the buckets that others have in their place."""
    def read(names: list[str]) -> DataFrame:
        reader = spark.read.schema(StructType.fromJson(json.loads(schema))) if schema else spark.read
        return reader.parquet(*[f"{path}/{name}" for name in names])

    groups: dict[tuple[int, ...], list[str]] = {}
    for run in runs:
        groups.setdefault(run.without, []).append(run.name)
    parts = [read(names).filter(~F.col("bucket").isin(*without)) if without else read(names) for without, names in groups.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_run(rows: DataFrame, path: str, key: str, level: int, name: str | None = None) -> tuple[Run, str]:
    """Write rows as a run, sorted by bucket and key; no snapshot names it yet."""
    spark = rows.sparkSession
    name = name or f"batch=-{uuid.uuid4().int >> 66}"
    placed = rows.drop("bucket").withColumn("bucket", bucket_of(F.col(key))).sortWithinPartitions("bucket", key)
    placed.write.mode("overwrite").parquet(f"{path}/{name}")
    return Run(name, level, spark.read.schema(placed.schema).parquet(f"{path}/{name}").count()), placed.schema.json()


def replaced(now: Snapshot, old: Sequence[Run], new: Sequence[Run]) -> Snapshot | None:
    """``now`` with new runs for old ones; ``None`` if those are no longer there as they were read."""
    if not set(old) <= set(now.runs):
        return None
    return replace(now, runs=tuple(r for r in now.runs if r not in old) + tuple(new))


# ---------------------------------------------------------------------- levels

@dataclass(frozen=True)
class Levels:
    """A table at ``path``; ``merge`` makes one row of all rows with the same ``key``."""

    spark: SparkSession
    path: str
    key: str
    merge: Callable[[DataFrame], DataFrame]
    fan: int = FAN

    def open(self) -> Snapshot:
        """Write the first snapshot, so that readers never look at a folder that is being written."""
        return commit(self.spark, self.path, lambda now: None if now.version else now)

    def append(self, rows: DataFrame, batch_id: int) -> Snapshot:
        """Add a batch, which has one row of a key, as a run; a batch that is there already changes nothing."""
        if batch_id <= self.open().last_batch:
            return snapshot(self.spark, self.path)
        run, schema = write_run(rows, self.path, self.key, 0, f"batch={batch_id}")

        def add(now: Snapshot) -> Snapshot | None:
            if batch_id <= now.last_batch:
                return None
            return replace(now, runs=now.runs + (run,), last_batch=batch_id, schema=schema)
        return commit(self.spark, self.path, add)

    def rows(self, at: Snapshot | None = None) -> DataFrame:
        """The merged rows of a snapshot, by default the newest; of a single run they need no merge."""
        at = at or snapshot(self.spark, self.path)
        if not at.runs:
            raise FileNotFoundError(f"{self.path} has no runs")
        rows = run_rows(self.spark, self.path, at.runs, at.schema)
        rows = rows.drop("bucket") if "bucket" in rows.columns else rows
        return rows if len(at.runs) == 1 else self.merge(rows)

    def _fold(self, at: Snapshot, runs: Sequence[Run], level: int) -> Snapshot:
        """One run of several; if another writer was faster with any of them, its work stands and this is dropped."""
        made, schema = write_run(self.rows(replace(at, runs=tuple(runs))), self.path, self.key, level)
        after = commit(self.spark, self.path, lambda now: (swap := replaced(now, runs, [made])) and replace(swap, schema=schema))
        if made not in after.runs:
            remove(self.spark, f"{self.path}/{made.name}")
        return after

    def settle(self) -> Snapshot:
        """Merge the runs of every level that has ``fan`` of them; beside writers and readers."""
        while True:
            now = snapshot(self.spark, self.path)
            held = Counter(run.level for run in now.runs)
            full = [level for level, n in held.items() if n >= self.fan]
            if not full:
                return now
            self._fold(now, [run for run in now.runs if run.level == min(full)], min(full) + 1)

    def compact(self) -> Snapshot:
        """Merge all runs into one; beside writers and readers.  Batches that come meanwhile stay runs of their own."""
        now = self.open()
        if len(now.runs) < 2 and not any(r.without for r in now.runs):
            return now
        return self._fold(now, now.runs, max(r.level for r in now.runs) + 1)
