"""Helpers that several operators share: words, connected components, wide ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import new_path, remove

# Words are what is left between these: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text with A-Z in lower case; a null text has none."""
    return text.lower().split() if text else []


def utf8(column: str) -> Column:
    """A text column as bytes: Python workers then get no decoding cost, and any text survives."""
    return F.col(column).cast("binary")


ROWS_PER_BATCH = 1_000


def whole_texts(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches held to ``ROWS_PER_BATCH`` rows.

    The usual 10,000 rows are made for narrow tables; of whole texts they are
    hundreds of megabytes, in the JVM and again in Python.  A session with
    smaller batches keeps its own.
    """
    setting, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if not 0 < int(conf.get(setting)) <= ROWS_PER_BATCH:
        conf.set(setting, str(ROWS_PER_BATCH))
    return docs


def map_rows(docs: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``function`` on batches of all columns of ``docs``, known by their place: names may hold dots or be equal."""
    plain = whole_texts(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(batches(function), plain.schema).toDF(*docs.columns)


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def batches(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """A ``mapInArrow`` function from a function on one batch."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = function(batch)
            if made is not None:
                yield made
    return run


class Steps:
    """Tables of an iteration: each step is written to the shared folder, and the one before it is deleted."""

    def __init__(self, spark, label: str):
        self.spark, self.label, self.last = spark, label, None

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.label)
        df.write.parquet(path)
        self.drop()
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        if self.last:
            remove(self.spark, self.last)
            self.last = None


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; ``root`` is the smallest node that it can reach.

    Alternates the two star steps of Kiveris et al. (2014).  A step takes the
    minimum of each neighbourhood by a pre-aggregated ``groupBy`` and joins it
    back, so no neighbourhood is ever gathered, however large.  Steps are
    written to the shared folder, which also cuts the lineage.
    """
    spark = edges.sparkSession
    steps = Steps(spark, "components")
    kept = steps.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = kept.union(kept.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        made = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        kept = steps.keep(made.filter("a > b").distinct())
        found = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        kept.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
