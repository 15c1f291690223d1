"""Running numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

# monotonically_increasing_id() holds the partition above this many bits.
PARTITION_SHIFT = 33


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Number the rows of every group of ``keys`` in ``order``, from 1, without gathering a group.

    The rows are sorted once, by range, so a group of any size spans as many
    tasks as its rows need; every task numbers its own rows.  The rows of a
    group in earlier tasks are added from counts that have one row per task
    and group.  Null keys are a group of their own.  ``df`` is read twice for
    the ranges: pass a stored table, not a long plan.
    """
    laid = stored(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id()), "numbered",
    ).withColumn("_task", F.shiftright("_at", PARTITION_SHIFT))
    parts = laid.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_task").alias("_in"), "_first", "_before")
    same = F.col("_task") == F.col("_in")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return laid.join(before, same).withColumn(
        name, F.col("_before") + F.col("_at") - F.col("_first") + 1
    ).select(*df.columns, name)


def running_number(df: DataFrame, key: Column, chat: str, message: str, name: str) -> DataFrame:
    """Number the rows of every ``key`` group in ``(chat, message)`` order, from 1."""
    return numbered(df.withColumn("_key", key), ["_key"], [chat, message], name).drop("_key").withColumn(name, F.col(name).cast("int"))
