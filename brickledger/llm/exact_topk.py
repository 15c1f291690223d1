"""Exact top-k search by inner product, term at a time over whole posting lists.

A task turns a batch of candidates into posting lists, one per component.  A
block of query rows then scatters its weights over these lists into a dense
array of scores, the best are taken by partition selection, and the lists of
all tasks are merged.  No score is skipped or bounded away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import new_path, stored

QUERY_BLOCK = 1024  # rows of queries that are broadcast and scored at once
LIMIT = 1 << 63  # of scores and weights
BATCH = 2048  # candidates whose scores a task holds at once: 16 MB with a full block


def usable(vector: str) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(vectors: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """``(id, weights)`` with ``floor(factor * x)`` of each component; rows without an id or a usable vector go.

    A component that is no 64-bit integer then is an error.
    """
    def weight(x: Column) -> Column:
        wide = F.abs(x.cast("double") * factor) >= float(LIMIT)
        return F.when(wide, F.raise_error(F.lit("a scaled component is no 64-bit integer"))).otherwise(F.floor(x.cast("double") * factor)).cast("long")
    return vectors.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vector_col, weight).alias("weights"))


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and (row, component, weight) of every weight that is not zero."""
    lists = batch.column(1)
    lengths = np.diff(lists.offsets.to_numpy())
    weight = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = weight != 0
    return batch.column(0).to_numpy(zero_copy_only=False), row[there], term[there], weight[there]


def postings(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(term, kind="stable")
    terms, starts = np.unique(term[order], return_index=True)
    rows, weights = np.split(row[order], starts[1:]), np.split(weight[order], starts[1:])
    return {int(t): (r, w) for t, r, w in zip(terms, rows, weights)}


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each query with the highest score, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return query[place < k], ids[place < k], score[place < k]


def largest(lists: dict) -> dict[int, float]:
    return {term: float(np.abs(weight).max()) for term, (_, weight) in lists.items()}


def score_batch(batch: pa.RecordBatch, query_ids: np.ndarray, query_lists: dict, k: int):
    """Top k of one batch for every query of the block, as (query number, id, score).

    Where a sum could pass 64 bits it is made of Python's integers, and a score that does pass them is an error.
    """
    ids, *entries = flat(batch)
    lists = postings(*entries)
    most, most_asked = largest(lists), largest(query_lists)
    wide = sum(m * most_asked[term] for term, m in most.items() if term in most_asked) >= LIMIT / 2
    scores = np.zeros((len(query_ids), len(ids)), object if wide else np.int64)
    for term, (q, q_weight) in query_lists.items():
        if term in lists:
            row, weight = lists[term]
            if wide:
                scores[np.ix_(q, row)] += q_weight.astype(object)[:, None] * weight.astype(object)
            elif len(row) == len(ids) and len(q) == len(query_ids):
                scores += q_weight[:, None] * weight
            else:
                scores[np.ix_(q, row)] += q_weight[:, None] * weight
    allowed = query_ids[:, None] != ids
    if wide:
        if (np.abs(scores[allowed]) >= LIMIT).any():
            raise OverflowError("a score is no 64-bit integer")
        scores = np.where(allowed, scores, 0).astype(np.int64)
    scores[~allowed] = np.iinfo(np.int64).min
    if len(ids) > k:
        allowed &= scores >= np.partition(scores, len(ids) - k, axis=1)[:, [len(ids) - k]]
    q, row = np.nonzero(allowed)
    return best(q, ids[row], scores[q, row], k)


def query_blocks(queries: DataFrame) -> Iterator[pa.RecordBatch]:
    """The queries in blocks of ``QUERY_BLOCK``; the driver holds one partition's worth at most."""
    held: list = []
    schema = pa.schema([("id", pa.int64()), ("weights", pa.list_(pa.int64()))])

    def block():
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.list_(pa.int64()))], schema=schema)
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield block()
            held.clear()
    if held:
        yield block()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, factor: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` best of all other rows for every row that ``is_query`` holds for.

    Scores are exact integers; weights and scores beyond 64 bits are an error,
    never another number.  Equal scores go by the smaller id.  Components that one of two vectors lacks count
    as zero, so vectors of any length (also none) compare.  Rows with a null
    id, a null vector or a null or non-finite component take no part.  Rows
    with the query's own id are never its results; a query id that is
    repeated gives one result list.  An empty table gives no rows.

    The candidates are read once per block of queries and are never shuffled;
    only the lists of at most ``k`` rows per query and task are.
    """
    spark = vectors.sparkSession
    kept = stored(scaled(vectors, id_col, vector_col, factor).withColumn("asks", is_query), "weights")
    candidates = kept.select("id", "weights")
    queries = kept.filter("asks").select("id", "weights").dropDuplicates(["id"])
    path = new_path(spark, "topk")
    schema = "query_id long, rank int, id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in query_blocks(queries):
        sent = spark.sparkContext.broadcast(block)

        def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, *entries = flat(sent.value)
            lists, found = postings(*entries), [np.zeros(0, np.int64)] * 3
            for whole in source:
                for start in range(0, whole.num_rows, BATCH):
                    made = score_batch(whole.slice(start, BATCH), query_ids, lists, k)
                    found = best(*map(np.concatenate, zip(found, made)), k)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[found[0]]), *map(pa.array, found[1:])], ["query_id", "id", "score"])

        lists = candidates.mapInArrow(search, "query_id long, id long, score long")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        lists.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score").write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(schema).parquet(path)
