"""Approximate nearest neighbours over learned partitions.

The neighbour graph of a bounded sample is cut into balanced partitions.  A
small classifier learns them, every row is indexed under its most probable
one, and a query visits the most probable partitions until enough of the
probability is covered.  What it meets there is ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import stored
from .exact_topk import best, usable

SAMPLE_ROWS = 8_192  # rows that graph and classifier are fitted on; every row is indexed
NEIGHBOURS = 10  # of each sample row in the graph
ROWS_PER_PART = 256  # sample rows in a partition
HIDDEN = 128
EPOCHS = 40
CANDIDATE_BLOCK = 8_192  # rows of a partition that one task ranks
QUERY_BLOCK = 1_024


# ---------------------------------------------------------- graph and its cut

def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row."""
    n = len(unit)
    k = min(k, n - 1)
    near = np.empty((n, k), np.int64)
    for start in range(0, n, 1024):
        close = unit[start:start + 1024] @ unit.T
        close[np.arange(len(close)), np.arange(start, start + len(close))] = -np.inf
        near[start:start + 1024] = np.argpartition(-close, k - 1, axis=1)[:, :k] if k else 0
    return near


def halves(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for the nodes of one half: a cut at the median of the slowest mixing vector, then gainful swaps.

    ``a`` and ``b`` are the ends of the edges among the nodes, both ways.
    """
    n = len(nodes)
    degree = np.bincount(a, minlength=n) + 1e-9
    x = rng.standard_normal(n)
    for _ in range(60):
        x -= (x * degree).sum() / degree.sum()
        x = 0.5 * (x + np.bincount(a, weights=x[b], minlength=n) / degree)
        x /= np.linalg.norm(x) + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2:]] = True
    for _ in range(30):
        other = np.bincount(a, weights=(side[a] != side[b]).astype(float), minlength=n)
        gain = 2 * other - np.bincount(a, minlength=n)
        right, left = np.flatnonzero(side), np.flatnonzero(~side)
        right, left = right[np.argsort(-gain[right])], left[np.argsort(-gain[left])]
        pairs = min(len(right), len(left))
        good = int(((gain[right[:pairs]] + gain[left[:pairs]]) > 2).sum()) // 4
        if not good:
            break
        side[right[:good]], side[left[:good]] = False, True
    return side


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each row, in sizes that differ by one at most per level, cutting few edges of the graph."""
    n, rng = len(near), np.random.default_rng(1)
    a = np.repeat(np.arange(n), near.shape[1])
    b = near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    count = 1
    while count < parts:
        split = np.zeros(n, bool)
        for p in range(count):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[a] >= 0) & (place[b] >= 0)
            split[nodes] = halves(nodes, place[a[inside]], place[b[inside]], rng)
        part = 2 * part + split
        count *= 2
    return part


# ----------------------------------------------------------------- classifier

@dataclass
class Router:
    """One hidden layer; gives the probability of each partition."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, unit: np.ndarray) -> np.ndarray:
        z = np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_router(unit: np.ndarray, part: np.ndarray, near: np.ndarray, parts: int) -> Router:
    """Fit to where a row and its neighbours lie, by Adam over shuffled batches."""
    n, d = unit.shape
    rng = np.random.default_rng(2)
    wanted = np.zeros((n, parts))
    np.add.at(wanted, (np.arange(n), part), 1.0)
    for j in range(near.shape[1]):
        np.add.at(wanted, (np.arange(n), part[near[:, j]]), 1.0)
    wanted /= wanted.sum(axis=1, keepdims=True)
    p = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d) * np.sqrt(d) / 2, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * 0.1, np.zeros(parts)]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        order = rng.permutation(n)
        for start in range(0, n, 128):
            at = order[start:start + 128]
            x, hidden = unit[at], np.maximum(unit[at] @ p[0] + p[1], 0)
            got = Router(*p).probabilities(x)
            dz = (got - wanted[at]) / len(at)
            dh = (dz @ p[2].T) * (hidden > 0)
            step += 1
            for i, g in enumerate([x.T @ dh, dh.sum(0), hidden.T @ dz, dz.sum(0)]):
                g = g + 1e-4 * p[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return Router(*p)


def fit(sample: np.ndarray) -> Router:
    """Router of unit vectors; with few rows there is one partition."""
    parts = 1
    while parts * 2 * ROWS_PER_PART <= len(sample):
        parts *= 2
    near = neighbour_graph(sample, NEIGHBOURS) if parts > 1 else np.zeros((len(sample), 0), np.int64)
    return fit_router(sample, balanced_parts(near, parts), near, parts) if parts > 1 else Router(
        np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))


# ------------------------------------------------------------------- operator

def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equal width from lists: missing components are zero."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = col < width
    out[row[there], col[there]] = lists.flatten().to_numpy(zero_copy_only=False)[there]
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rank_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """The ``k`` nearest rows of each query.  Products of the whole block choose, sums by pair decide and report."""
    if not len(query_ids) or not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    close = queries @ rows.T
    close[query_ids[:, None] == ids] = -np.inf
    keep = np.isfinite(close)
    if len(ids) > k:
        keep &= close >= np.partition(close, len(ids) - k, axis=1)[:, [len(ids) - k]] - 1e-9
    q, row = np.nonzero(keep)
    score = np.empty(len(q))
    for start in range(0, len(q), 1 << 16):
        at = slice(start, start + (1 << 16))
        score[at] = np.einsum("ij,ij->i", queries[q[at]], rows[row[at]])
    return best(q, ids[row], score, k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, cover: float = 0.93, id_col: str = "vec_id",
            vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest found of all other rows for each row that ``is_query`` holds for.

    Nearness is the cosine in double precision; vectors of unlike length
    compare with zeros for what is missing.  Rows with a null id, and vectors
    that are null, zero, empty or hold null or non-finite components, take no
    part.  A repeated query id gives one list; rows with the query's id are
    never in it.  A query visits partitions until ``cover`` of the probability
    and at least ``2 * k + 2`` rows are met, so it finds ``k`` rows whenever
    there are as many.  An empty table gives no rows.

    A partition is searched in blocks of rows and queries, so none is ever
    gathered, however much of the data it holds.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(F.col(id_col).isNotNull() & usable(vector_col) & F.exists(vector_col, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))
    kept = stored(kept.withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    n, width = kept.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = width or 1
    thin = max(1, -(-n // sample_rows))
    sample = kept.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(thin)) == 0).select("vector").limit(sample_rows * 11 // 10)
    rows = pa.Table.from_pandas(sample.toPandas(), schema=pa.schema([("vector", pa.list_(pa.float64()))])).combine_chunks()
    chunks = rows.column("vector").chunks
    x = matrix(chunks[0], width) if chunks and len(chunks[0]) else np.zeros((0, width))
    router = spark.sparkContext.broadcast(fit(unit_rows(x) if len(x) else x))

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                likely = router.value.probabilities(unit_rows(matrix(part.column(1), width))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(likely.astype(np.int32))], ["id", "vector", "asks", "part"])

    placed = stored(kept.mapInArrow(place, "id long, vector array<double>, asks boolean, part int").withColumn(
        "seq", F.monotonically_increasing_id()), "indexed")
    held = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # one row per partition
    parts = len(router.value.b2)
    sizes = np.array([held.get(p, 0) for p in range(parts)])

    def route(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            p = router.value.probabilities(unit_rows(matrix(batch.column(1), width)))
            order = np.argsort(-p, axis=1, kind="stable")
            chance = np.take_along_axis(p, order, 1)
            before = np.cumsum(chance, axis=1) - chance
            met = np.cumsum(sizes[order], axis=1) - sizes[order]
            q, at = np.nonzero((before < cover) | (met < 2 * k + 2))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q)), pa.array(order[q, at].astype(np.int32))], ["id", "vector", "part"])

    queries = placed.filter("asks").select("id", "vector").dropDuplicates(["id"])
    routed = stored(queries.mapInArrow(route, "id long, vector array<double>, part int").withColumn("seq", F.monotonically_increasing_id()), "routed")
    asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}

    def dealt(df: DataFrame, own: dict, own_block: int, other: dict, other_block: int, mine: str, theirs: str) -> DataFrame:
        """Give each row its block, and a copy for each block of the other side in its partition."""
        counts = [(p, max(1, -(-own.get(p, 0) // own_block)), -(-other.get(p, 0) // other_block)) for p in range(parts)]
        table = spark.createDataFrame(counts, "part int, own int, other int").filter("other > 0")
        return df.join(F.broadcast(table), "part").select(
            "part", F.pmod(F.xxhash64("seq"), F.col("own")).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col("other") - 1)).alias(theirs), "id", "vector")

    candidates = dealt(placed, held, CANDIDATE_BLOCK, asked, QUERY_BLOCK, "block", "query_block")
    wanted = dealt(routed, asked, QUERY_BLOCK, held, CANDIDATE_BLOCK, "query_block", "block")

    def rank(queries: pa.Table, rows: pa.Table) -> pa.Table:
        def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            if not t.num_rows:
                return np.zeros(0, np.int64), np.zeros((0, width))
            t = t.combine_chunks()
            return t.column("id").to_numpy(), unit_rows(matrix(t.column("vector").chunks[0], width))
        query_ids, q = side(queries)
        ids, x = side(rows)
        at, found, score = rank_block(query_ids, q, ids, x, k)
        return pa.table({"query_id": pa.array(query_ids[at], pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ["part", "block", "query_block"]
    lists = wanted.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(rank, "query_id long, id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return lists.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
