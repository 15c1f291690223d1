"""The flagged inventory as a table of buckets, with edits written into it.

An edit rewrites the buckets of the listings it changes, and of those whose
flag changes with them, as a new run that stands in for these buckets of the
older ones.  All other files stay as they are, and a killed edit leaves the
old snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import POST_ORDER
from .edits import apply_edits
from .levels import BUCKETS, Levels, Run, Snapshot, bucket_of, commit, run_rows, snapshot, write_run
from .storage import remove, scratch, stored

MOST_BROADCAST = 100_000  # edits, or groups they touch; more are joined by shuffle
KEY = "dedup_key"


def managed(spark: SparkSession, path: str) -> Levels:
    """The table; its runs have no key in common, so a merge only puts them together."""
    return Levels(spark, path, KEY, lambda rows: rows)


def write_managed(inventory: DataFrame, path: str) -> Snapshot:
    """Write a flagged inventory as a new managed table."""
    if "is_duplicate" not in inventory.columns:
        raise ValueError("a managed table holds a flagged inventory")
    return managed(inventory.sparkSession, path).append(inventory, 0)


def read_managed(spark: SparkSession, path: str, at: Snapshot | None = None) -> DataFrame:
    """The inventory of a snapshot, by default the newest, with its flags."""
    return managed(spark, path).rows(at)


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _group(left: DataFrame, right: DataFrame):
    return left.society.eqNullSafe(right.society) & left.dealer.eqNullSafe(right.dealer)


def _buckets(*parts: DataFrame) -> list[int]:
    """Numbers of buckets, at most ``BUCKETS``."""
    found: set[int] = set()
    for df in parts:
        found |= {r[0] for r in df.select("bucket").distinct().collect()}
    return sorted(found)


def edited_buckets(rows: DataFrame, edits: DataFrame) -> tuple[list[int], DataFrame]:
    """Buckets that edits touch, and their rows afterwards; ``rows`` is the table with its ``bucket``.

    The inventory is not shuffled: edits, the groups of society and dealer
    that they touch, and the newest listing of each go to its tasks.
    """
    columns = [c for c in rows.columns if c not in ("bucket", "is_duplicate")]
    ids = _sized(stored(edits.select(F.col("id").alias("_id")).distinct().withColumn("bucket", bucket_of(F.col("_id")))))
    named = _buckets(ids)
    if not named:
        return [], rows.limit(0)
    edited = F.col(KEY) == F.col("_id")
    old = stored(rows.filter(F.col("bucket").isin(named)).join(ids.select("_id"), edited, "left_semi"))
    new = stored(apply_edits(old.select(*columns), edits).withColumn("bucket", bucket_of(F.col(KEY))))
    groups = _sized(stored(old.select("society", "dealer").union(new.select("society", "dealer")).distinct()))
    kept = rows.join(ids.select("_id"), edited, "left_anti")
    order = ["society", "dealer", KEY, "ts", *POST_ORDER]
    members = kept.join(groups, _group(kept, groups), "left_semi")
    newest = _sized(stored(members.select(*order).union(new.select(*order)).groupBy("society", "dealer").agg(
        F.max_by(KEY, F.struct("ts", *POST_ORDER)).alias("_newest"))))
    flag = F.col(KEY) != F.col("_newest")
    changed = members.join(newest, _group(members, newest)).filter(flag != F.col("is_duplicate"))
    touched = _buckets(old, new, changed)
    part = kept.filter(F.col("bucket").isin(touched)).unionByName(new.withColumn("is_duplicate", F.lit(None).cast("boolean")))
    told = part.join(newest, _group(part, newest), "left").select(
        *[part[c] for c in rows.columns if c != "is_duplicate"], F.coalesce(flag, part["is_duplicate"]).alias("is_duplicate"))
    return touched, told.select(*rows.columns)


def _without(runs: Sequence[Run], buckets: list[int]) -> tuple[Run, ...]:
    """Runs less buckets that another one now has; a run without any is gone."""
    less = [replace(run, without=tuple(sorted({*run.without, *buckets}))) for run in runs]
    return tuple(run for run in less if len(run.without) < BUCKETS)


def edit_managed(spark: SparkSession, path: str, edits: DataFrame) -> Snapshot:
    """Write updates, deletions and additions into the table; returns the snapshot that has them.

    Edits mean what they mean to ``apply_edits``.  If another writer commits
    in between, the edits are applied to what that one has made.
    """
    while True:
        with scratch(spark):
            now = snapshot(spark, path)
            touched, rows = edited_buckets(run_rows(spark, path, now.runs, now.schema), edits)
            if not touched:
                return now
            run, schema = write_run(rows, path, KEY, 0)

            def change(current: Snapshot, run: Run = run) -> Snapshot | None:
                if current.version != now.version:
                    return None
                return replace(current, runs=_without(current.runs, touched) + ((run,) if run.rows else ()), schema=schema)
            after = commit(spark, path, change)
        done = after.version == now.version + 1 and (run in after.runs or not run.rows)
        if not (done and run.rows):
            remove(spark, f"{path}/{run.name}")
        if done:
            return after
