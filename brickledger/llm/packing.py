"""Packing documents into padded batches of equal token budget, with optimal length buckets.

A dynamic program over the histogram of all lengths places the bucket borders
so that padding is least.  Inside each bucket, documents are numbered and
dealt to batches of as many rows as the budget holds at the bucket's border.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..operators.storage import stored

# Lengths of up to 11 binary digits are told apart; longer ones share cells by their first 11.
# The histogram thus has at most 2048 + 1024 rows per further doubling, whatever the input.
CELL_DIGITS = 11


def cell_of(length: Column) -> Column:
    """The length, rounded up to its first ``CELL_DIGITS`` binary digits."""
    digits = F.length(F.bin(length))
    step = F.pow(F.lit(2.0), F.greatest(digits - CELL_DIGITS, F.lit(0))).cast("long")
    return (F.ceil(length / step) * step).cast("long")


def best_borders(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Borders of at most ``buckets`` buckets with the least total of rows times border, and that total.

    ``lengths`` ascend.  The best last bucket starts no earlier for longer
    prefixes, so each layer is filled by halving the range of starts.
    """
    n = len(lengths)
    if not n:
        return [], 0
    below = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    layer = lengths * below[1:]  # one bucket: all rows padded to the last length
    starts = []
    for _ in range(1, min(buckets, n)):
        cost, start = np.empty(n, np.int64), np.zeros(n, np.int64)
        work = [(0, n - 1, 0, n - 1)]
        while work:
            lo, hi, first, last = work.pop()
            mid = (lo + hi) // 2
            at = np.arange(first, min(mid, last) + 1)  # the last bucket holds at..mid
            total = np.where(at > 0, layer[at - 1], 0) + lengths[mid] * (below[mid + 1] - below[at])
            best = int(np.argmin(total))
            cost[mid], start[mid] = total[best], at[best]
            if lo < mid:
                work.append((lo, mid - 1, first, int(at[best])))
            if mid < hi:
                work.append((mid + 1, hi, int(at[best]), last))
        layer = cost
        starts.append(start)
    borders, end = [], n - 1
    for start in [*reversed(starts), None]:
        borders.append(int(lengths[end]))
        if start is None or start[end] == 0:
            break
        end = int(start[end]) - 1
    return borders[::-1], int(layer[-1])


def pack(docs: DataFrame, length: Column, budget: int = 16_384, buckets: int = 32, id_col: str = "doc_id") -> DataFrame:
    """``(id, length, bucket, pad_to, batch, place)`` of every row, whole texts only.

    ``batch`` numbers the batches of a bucket from 0, ``place`` the rows of a
    batch from 0.  A batch holds ``budget // pad_to`` rows, or the one row that
    is longer than the budget; only the last batch of a bucket may hold fewer.
    ``pad_to`` is the longest row of the bucket.  Padding is the least of all
    borders up to 2,048, and beyond of those between two cells of lengths.
    Null lengths count as 0.  Null and repeated ids are rows like others, and
    an empty table gives no rows.
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("length")), "lengths")
    histogram = rows.groupBy(cell_of(F.col("length")).alias("cell")).agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("cell").toPandas()
    borders, _ = best_borders(histogram["longest"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets)
    edges = F.array(*[F.lit(b).cast("long") for b in borders or [0]])
    bucket = F.size(F.filter(edges, lambda b: b < F.col("length")))
    dealt = rows.withColumn("bucket", bucket).withColumn("order", F.xxhash64("id", "length"))
    placed = numbered(dealt, ["bucket"], ["order", "id", "length"], "number")
    pad_to = F.element_at(edges, F.col("bucket") + 1)
    holds = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(pad_to, F.lit(1)))).cast("long")
    at = F.col("number") - 1
    return placed.select("id", "length", "bucket", pad_to.alias("pad_to"), F.floor(at / holds).cast("long").alias("batch"), (at % holds).cast("long").alias("place"))
