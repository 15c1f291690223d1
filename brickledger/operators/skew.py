"""Work that stays even: joins when one key holds a large share of the rows, and rows that cost far more than their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 1_000_000
# Most heavy keys sent to every executor.  Their number is at most
# rows / ROWS_PER_TASK, so this covers 2e11 rows.
MAX_HEAVY_KEYS = 200_000
# Tasks for each core where a row costs far more than moving it.
TASKS_PER_CORE = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over several tasks for each core, by ``keys`` that hardly repeat.

    Adaptive execution joins the tasks after a shuffle up to a number of
    bytes.  Where each row takes long that leaves few long tasks, and one more
    than there are cores makes a stage take twice the time.  A number of tasks
    that is asked for stays.  Reduce the rows first, since all of them move.
    """
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *keys)


def heavy_keys(counts: DataFrame, key: str, n: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(key, copies)`` of the keys that need more than one task."""
    return counts.filter(F.col(n) > rows_per_task).select(
        key, F.ceil(F.col(n) / F.lit(rows_per_task)).cast("int").alias("_copies")
    )


def spread_join(
    many: DataFrame, one: DataFrame, key: str, heavy: DataFrame, spread_by: list[str], max_heavy_keys: int = MAX_HEAVY_KEYS
) -> DataFrame:
    """Inner join of a skewed side with a side that has few rows per key.

    The rows of a heavy key are dealt out over its copies on the other side;
    all other keys keep a single copy.  ``heavy`` is counted first: beyond
    ``max_heavy_keys`` it is joined by shuffle rather than broadcast.
    """
    if heavy.isEmpty():
        return many.join(one, key)
    if heavy.count() <= max_heavy_keys:
        heavy = F.broadcast(heavy)
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    dealt = many.join(heavy, key, "left").withColumn(
        "_copy", F.pmod(F.xxhash64(*spread_by), copies.cast("long")).cast("int")
    ).drop("_copies")
    copied = one.join(heavy, key, "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), copies - 1))
    ).drop("_copies")
    return dealt.join(copied, [key, "_copy"]).drop("_copy")
