"""Substring search that reads only where a hit can be.

Rows lie in blocks, numbered along the files.  The postings say which blocks
hold a trigram; they are flat rows sorted by trigram and block, which Parquet
keeps as a dictionary and as differences.  A search looks up the trigrams
between the wildcards, reads the blocks that hold all of them, and tests their
rows as a scan would.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import let
from .levels import Run, Snapshot, commit, snapshot
from .search import like_pattern

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS  # rows
GRAM = 3  # characters
MOST_LOOKED_UP = 10  # trigrams of a query, spread over it; fewer than all only let more blocks in
MOST_BLOCKS = 2_000  # that a search names in its filter; more are joined


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none for shorter texts."""
    def every(letters: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(letters) - GRAM)
        return F.transform(starts, lambda i: F.concat(*[F.get(letters, i + k) for k in range(GRAM)]))

    # the letters are split once for all runs, else a long text costs its square
    return let(F.split(F.lower(text), ""), lambda letters: F.array_distinct(
        F.when(F.size(letters) >= GRAM, every(letters)).otherwise(F.array().cast("array<string>"))))


def looked_up(lowered: str) -> list[str]:
    """Trigrams that a text in lower case must hold to match a query; ``%`` and ``_`` end a literal."""
    literals = lowered.replace("_", "%").split("%")
    found = list(dict.fromkeys(x[i:i + GRAM] for x in literals for i in range(len(x) - GRAM + 1)))
    if len(found) <= MOST_LOOKED_UP:
        return found
    return [found[i * (len(found) - 1) // (MOST_LOOKED_UP - 1)] for i in range(MOST_LOOKED_UP)]


def ranges(numbers: list[int]) -> list[tuple[int, int]]:
    """Runs of numbers without a gap, first and last, of sorted numbers."""
    ends = [i for i, (a, b) in enumerate(pairwise(numbers)) if b != a + 1]
    return [(numbers[a], numbers[b]) for a, b in zip([0, *[e + 1 for e in ends]], [*ends, len(numbers) - 1])] if numbers else []


@dataclass(frozen=True)
class TextIndex:
    """Rows at ``path`` with an index of their column ``text``."""

    spark: SparkSession
    path: str
    text: str = "text_data"

    def add(self, rows: DataFrame, batch_id: int, order: str | None = None) -> Snapshot:
        """Add a batch of rows, sorted by ``order`` if there is one; a batch that is there already changes nothing.

        A null text is never found.
        """
        if batch_id <= snapshot(self.spark, self.path).last_batch:
            return snapshot(self.spark, self.path)
        name = f"batch={batch_id}"
        if order:
            rows = rows.repartitionByRange(order).sortWithinPartitions(order)
        # a block never spans two files, since a running number holds the number of its task in front
        placed = rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
        placed.write.mode("overwrite").option("parquet.page.row.count.limit", BLOCK).parquet(f"{self.path}/rows/{name}")
        kept = self.spark.read.schema(placed.schema).parquet(f"{self.path}/rows/{name}")
        postings = kept.select(F.explode(trigrams(F.col(self.text))).alias("gram"), "block").distinct()
        postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").option(
            "parquet.writer.version", "v2").parquet(f"{self.path}/grams/{name}")
        run = Run(name, 0, kept.count())

        def put(now: Snapshot) -> Snapshot | None:
            if batch_id <= now.last_batch:
                return None
            return replace(now, runs=now.runs + (run,), last_batch=batch_id, schema=placed.schema.json())
        return commit(self.spark, self.path, put)

    def _table(self, kind: str) -> DataFrame:
        runs = snapshot(self.spark, self.path).runs
        if not runs:
            raise FileNotFoundError(f"{self.path} has no batch")
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/{run.name}" for run in runs])

    def hit_blocks(self, query: str) -> DataFrame | None:
        """``(batch, block)`` that may hold a match; ``None`` if the query has no literal of three characters."""
        # by the session, since a pattern is lowered as a whole, and as the texts are
        lowered = self.spark.range(1).select(F.lower(F.lit(query.strip()))).first()[0]
        grams = looked_up(lowered)
        if not grams:
            return None
        met = self._table("grams").filter(F.col("gram").isin(grams)).groupBy("batch", "block").agg(F.count("*").alias("n"))
        return met.filter(F.col("n") == len(grams)).select("batch", "block")

    def search(self, query: str) -> DataFrame:
        """Rows whose text holds ``query`` as ``search_messages`` means it: case is ignored, ``%`` and ``_`` are wildcards.

        A query without a literal of three characters reads every row, with a warning.
        """
        rows, wanted = self._table("rows"), F.col(self.text).ilike(like_pattern(query))
        blocks = self.hit_blocks(query)
        if blocks is None:
            warnings.warn(f"no three characters in a row in {query!r}: every row is read", stacklevel=2)
            return rows.filter(wanted).drop("batch", "block")
        known = blocks.limit(MOST_BLOCKS + 1).collect()
        if len(known) > MOST_BLOCKS:
            return rows.join(blocks, ["batch", "block"], "left_semi").filter(wanted).drop("batch", "block")
        here = F.lit(False)
        for batch in sorted({r["batch"] for r in known}):
            spans = ranges(sorted(r["block"] for r in known if r["batch"] == batch))
            within = F.lit(False)
            for first, last in spans:
                within |= F.col("block").between(first, last)
            here |= (F.col("batch") == batch) & within
        return rows.filter(here).filter(wanted).drop("batch", "block")
