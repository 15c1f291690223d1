"""Near copies among embeddings by product quantisation.

Vectors lie in inverted lists of a coarse quantiser, with codes of their
residuals in subspaces.  A vector looks up its distance to the codes of all
lists that may hold a vector within reach, and what the codes cannot rule out
is decided by the exact cosine.  Both prunings are bounds, so no link is lost:

* a vector within the angle reach of ``q`` that is nearer to centroid ``c`` than
  to the nearest centroid of ``q`` lies behind the plane between the two, so
  ``c`` is probed unless that plane is farther away than the reach;
* a vector is no nearer than its code less the code's error, which is stored.

Dense spots get lists of their own: balls so small that all vectors in them
link.  They are counted as a whole, and so is a ball that a vector reaches in
full, so a group of very many near copies is never compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import ROWS_PER_TASK, heavy_keys, spread_join
from ..operators.storage import stored
from .ann import matrix, unit_rows
from .common import components
from .exact_topk import usable

SAMPLE_ROWS = 16_384  # distinct vectors that quantisers and dense spots are fitted on; every row is indexed
ROWS_PER_LIST = 256  # of the largest label
MOST_LISTS = 1_024
SUBSPACES = 16
CODES = 256
CODE_SAMPLE = 8_192
DENSE = 8  # sample rows in a dense spot
BLOCK = 8_192  # rows of a list, and of its visitors, that one task compares
CHUNK = 256
SLACK = 1e-6  # of angles
CLOSE = 1e-11  # cosines this near the threshold are computed once more, in longer floats


# ------------------------------------------------------------------ quantisers

def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres ** 2).sum(1) / 2
    return np.concatenate([(x[i:i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, on_sphere: bool = False) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at, before = nearest(x, centres), centres
        held = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
        if on_sphere:  # a mean without a direction keeps the old one
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), before)
    return centres


def dense_spots(unit: np.ndarray, label: np.ndarray, angle: float) -> np.ndarray:
    """Numbers of rows with many others of their label within ``angle``, none within it of another."""
    least, taken, spots = np.cos(angle), np.zeros(len(unit), bool), []
    for value in np.unique(label):
        at = np.flatnonzero(label == value)
        own = unit[at]
        many = np.concatenate([(own[i:i + 1024] @ own.T >= least).sum(1) for i in range(0, len(at), 1024)])
        for r in np.argsort(-many, kind="stable")[:(many >= DENSE).sum()]:
            if not taken[at[r]]:
                others = at[own @ own[r] >= least]
                if (~taken[others]).sum() >= DENSE:
                    spots.append(at[r])
                    taken[others] = True
    return np.array(spots, np.int64)


@dataclass
class Index:
    """What every task needs to place, route and decode vectors.  Lists from ``len(centres)`` on are balls."""

    width: int
    similarity: float
    centres: np.ndarray  # unit centroids of the coarse quantiser
    hubs: np.ndarray  # centres of dense spots
    hub_label: np.ndarray
    books: list[np.ndarray]  # codebook of each subspace
    cuts: np.ndarray  # where subspaces begin and end

    @property
    def reach(self) -> float:
        return float(np.arccos(self.similarity))

    def angles_to_hubs(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        angle = np.arccos(np.clip(unit @ self.hubs.T, -1, 1))
        angle[label[:, None] != self.hub_label] = np.inf
        return angle

    def home(self, unit: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each vector, and its angle to the centre if that is a ball."""
        at, angle = nearest(unit, self.centres), np.zeros(len(unit))
        if len(self.hubs):
            to_hub = self.angles_to_hubs(unit, label)
            hub = to_hub.argmin(1)
            least = to_hub[np.arange(len(unit)), hub]
            inside = least <= self.reach / 2 - SLACK
            at, angle = np.where(inside, len(self.centres) + hub, at), np.where(inside, least, 0.0)
        return at, angle

    def centre(self, at: np.ndarray) -> np.ndarray:
        return np.concatenate([self.centres, self.hubs])[at]

    def encode(self, unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the residuals; what does not depend on the asking row of its squared distance to them; their error."""
        centre = self.centre(at)
        residual = unit - centre
        codes = np.stack([nearest(residual[:, a:b], book) for book, a, b in self.parts()], axis=1).astype(np.uint8)
        coded = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        return codes, (coded * (coded + 2 * centre)).sum(1), np.linalg.norm(residual - coded, axis=1)

    def parts(self):
        return zip(self.books, self.cuts, self.cuts[1:])

    def squared_distances(self, unit: np.ndarray, centre: np.ndarray, codes: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Asymmetric: from exact rows to coded ones of a list, by adding up entries of a table for each row and subspace.

        The tables hold products with the codebook, which are the same for every list.
        """
        total = ((unit - centre) ** 2).sum(1)[:, None].astype(np.float32) + base.astype(np.float32)
        for s, (book, a, b) in enumerate(self.parts()):
            total -= (unit[:, a:b] @ (2 * book.T)).astype(np.float32).take(codes[:, s], axis=1)
        return total


def fit(unit: np.ndarray, label: np.ndarray, lists: int, similarity: float) -> Index:
    rng, width = np.random.default_rng(1), unit.shape[1]
    angle = float(np.arccos(similarity)) / 2 - SLACK
    spots = dense_spots(unit, label, angle)
    centres = k_means(unit, lists, 12, rng, on_sphere=True)
    some = unit[:CODE_SAMPLE]
    residual = some - centres[nearest(some, centres)]
    cuts = np.unique(np.linspace(0, width, SUBSPACES + 1).astype(int))
    books = [k_means(residual[:, a:b], CODES, 6, rng) for a, b in zip(cuts, cuts[1:])]
    return Index(width, similarity, centres, unit[spots], label[spots], books, cuts)


# ---------------------------------------------------------------------- blocks

def exact(cosine: np.ndarray, q: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """True where a cosine reaches the threshold; products of a block are off in their last digits, so near ones are summed again."""
    linked = cosine >= similarity
    i, j = np.nonzero(np.abs(cosine - similarity) < CLOSE)
    if len(i):
        a, b = q[i].astype(np.longdouble), y[j].astype(np.longdouble)
        again = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        linked[i, j] = again.astype(float) >= similarity
    return linked


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each place is connected with, after the links ``a - b`` are added to ``root``."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(index: Index, at: int, visitors: dict, held: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(node, links, root)`` of one block: links weighed by the copies at their other end, and a forest of the linked."""
    nodes, v_unit, v_copies, v_home = visitors["node"], visitors["unit"], visitors["copies"], visitors["home"]
    names = np.concatenate([nodes, held["node"]])
    links, root = np.zeros(len(names), np.int64), np.arange(len(names))
    centre, far = index.centre(np.array([at])), 2 - 2 * index.similarity
    # a squared distance up to this may be one within reach: the code is off by its error, float32 by a little
    limit = ((np.sqrt(far) + held["error"]) ** 2 + 1e-4).astype(np.float32)
    for start in range(0, len(nodes), CHUNK):
        part = slice(start, start + CHUNK)
        maybe = index.squared_distances(v_unit[part], centre, held["codes"], held["base"]) <= limit
        # of two rows of this list the one with the smaller number asks
        maybe &= (v_home[part] != at)[:, None] | (nodes[part, None] < held["node"])
        columns = np.flatnonzero(maybe.any(0))
        if not len(columns):
            continue
        rows = held["unit"][columns]
        linked = exact(v_unit[part] @ rows.T, v_unit[part], rows, index.similarity) & maybe[:, columns]
        links[np.arange(len(nodes))[part]] += linked @ held["copies"][columns]
        links[len(nodes) + columns] += v_copies[part] @ linked
        i, j = np.nonzero(linked)
        root = joined(root, start + i, len(nodes) + columns[j])
    keep = links > 0
    return names[keep], links[keep], names[root[keep]]


# ------------------------------------------------------------------- operator

def linked_nodes(nodes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(node, links)`` and edges ``(a, b)`` that connect what is linked, of ``nodes(node, label, vector, copies)``."""
    spark = nodes.sparkSession
    n, width = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return nodes.select("node", F.lit(0).cast("long").alias("links")), nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0]
    thin = max(1, -(-n // SAMPLE_ROWS))
    sample = nodes.filter(F.pmod(F.xxhash64("vector", "label"), F.lit(thin)) == 0).select("label", "vector").limit(SAMPLE_ROWS * 5 // 4)
    drawn = sample.toArrow().combine_chunks()
    if not drawn.num_rows:
        drawn = nodes.select("label", "vector").limit(1).toArrow().combine_chunks()
    lists = min(MOST_LISTS, max(1, largest // ROWS_PER_LIST))
    order = np.random.default_rng(2).permutation(drawn.num_rows)
    unit = unit_rows(matrix(drawn.column("vector").chunk(0), width))[order]
    index = spark.sparkContext.broadcast(fit(unit, drawn.column("label").to_numpy()[order], lists, similarity))
    coarse = len(index.value.centres)

    def unit_of(column: pa.Array) -> np.ndarray:
        return unit_rows(matrix(column, width))

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = unit_of(batch.column("vector"))
                at, angle = index.value.home(x, batch.column("label").to_numpy())
                codes, base, error = index.value.encode(x, at)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(at.astype(np.int32)), pa.array(angle), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(base),
                     pa.array(error)], [*batch.schema.names, "home", "angle", "codes", "base", "error"])

    schema = f"node long, label long, vector {nodes.schema['vector'].dataType.simpleString()}, copies long"
    placed = stored(nodes.select("node", "label", "vector", "copies").mapInArrow(place, f"{schema}, home int, angle double, codes binary, base double, error double"), "placed")
    balls = placed.filter(F.col("home") >= coarse).groupBy("home").agg(  # at most SAMPLE_ROWS / DENSE rows
        F.max("angle").alias("angle"), F.sum("copies").alias("copies"), F.min("node").alias("node"))
    found = {r["home"]: r for r in balls.collect()}
    radius = np.array([found[coarse + h]["angle"] if coarse + h in found else -np.inf for h in range(len(index.value.hubs))])

    def route(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists that a vector must visit, each pair of lists from one side: smaller coarse lists ask larger ones, all ask balls, balls larger balls."""
        ix = index.value
        for whole in source:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x, label, home = unit_of(batch.column("vector")), batch.column("label").to_numpy(), batch.column("home").to_numpy()
                close = x @ ix.centres.T
                best = close.argmax(1)
                gap = np.sqrt(np.maximum(2 - 2 * ix.centres[best] @ ix.centres.T, 0))
                # the angle to the plane between two centroids, by its sine
                behind = close[np.arange(len(x)), best][:, None] - close <= (np.sin(ix.reach) + SLACK) * gap + SLACK
                number = np.arange(coarse)
                ask = behind & ((home[:, None] < number) | (home[:, None] == number))
                q, at = np.nonzero(ask)
                whole_ball = np.zeros(len(q), bool)
                if len(ix.hubs):
                    angle = ix.angles_to_hubs(x, label)
                    asked = (angle <= ix.reach + radius + SLACK) & (home[:, None] < coarse + np.arange(len(ix.hubs)))
                    inside = asked & (angle <= ix.reach - radius - SLACK)
                    hq, ball = np.nonzero(asked)
                    q, at, whole_ball = np.append(q, hq), np.append(at, coarse + ball), np.append(whole_ball, inside[hq, ball])
                rows = pa.array(q)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(rows) for c in ("node", "label", "vector", "copies", "home")], pa.array(at.astype(np.int32)), pa.array(whole_ball)],
                    ["node", "label", "vector", "copies", "home", "at", "whole"])

    routed = stored(placed.select("node", "label", "vector", "copies", "home").mapInArrow(route, f"{schema}, home int, at int, whole boolean"), "routed")
    asked = routed.filter("NOT whole")

    held_in = placed.groupBy("label", F.col("home").alias("at")).agg(F.count("*").alias("held"))
    asked_of = asked.groupBy("label", "at").agg(F.count("*").alias("asked"))
    # a row for each label and list
    sizes = stored(held_in.join(asked_of, ["label", "at"]).select(
        "label", "at", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / BLOCK).cast("int").alias("groups")), "sizes")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one part of its own side, once for each part of the other side."""
        return df.join(sizes, ["label", "at"]).withColumns({
            f"my_{own}": F.pmod(F.xxhash64("node"), F.col(own)).cast("int"), f"my_{other}": F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop("blocks", "groups")

    keys = ["label", "at", "my_blocks", "my_groups"]
    candidates = dealt(placed.select("node", "label", "vector", "copies", "codes", "base", "error", F.col("home").alias("at")), "blocks", "groups")
    visitors = dealt(asked.drop("whole"), "groups", "blocks")

    def block(visiting: pa.Table, held: pa.Table) -> pa.Table:
        made = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if visiting.num_rows and held.num_rows:
            v, h = visiting.combine_chunks(), held.combine_chunks()
            side = {"node": v["node"].to_numpy(), "unit": unit_of(v["vector"].chunk(0)), "copies": v["copies"].to_numpy(), "home": v["home"].to_numpy()}
            codes = np.frombuffer(b"".join(h["codes"].to_pylist()), np.uint8).reshape(h.num_rows, -1)
            other = {"node": h["node"].to_numpy(), "unit": unit_of(h["vector"].chunk(0)), "copies": h["copies"].to_numpy(), "codes": codes,
                     "base": h["base"].to_numpy(), "error": h["error"].to_numpy()}
            made = compare(index.value, v["at"][0].as_py(), side, other)
        return pa.table({"node": made[0], "links": made[1], "root": made[2]})

    compared = stored(visitors.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(block, "node long, links long, root long"), "compared")
    ball = F.broadcast(spark.createDataFrame(  # at most SAMPLE_ROWS / DENSE rows
        [(h, r["copies"], r["node"]) for h, r in found.items()], "ball int, ball_copies long, ball_node long"))
    inside = placed.select("node", "copies", "home").join(ball, F.col("home") == F.col("ball"))
    reached = routed.filter("whole").select("node", "copies", "at").join(ball, F.col("at") == F.col("ball"))
    visits = reached.groupBy("ball").agg(F.sum("copies").alias("visits"))  # a row for each ball
    counts = compared.select("node", "links").unionByName(inside.select("node", (F.col("ball_copies") - F.col("copies")).alias("links"))).unionByName(
        reached.select("node", F.col("ball_copies").alias("links"))).unionByName(
        inside.select("node", "home").join(F.broadcast(visits), F.col("home") == F.col("ball")).select("node", F.col("visits").alias("links")))
    edges = compared.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(
        inside.select(F.col("node").alias("a"), F.col("ball_node").alias("b"))).unionByName(
        reached.select(F.col("node").alias("a"), F.col("ball_node").alias("b")))
    return counts.groupBy("node").agg(F.sum("links").alias("links")), edges


def near_copies(vectors: DataFrame, similarity: float = 0.93, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(id, n_links, component, kept)`` of every row: rows it links with, smallest id it reaches by links, and whether that is its own.

    Rows link if their labels are equal and their cosine, in double precision,
    is at least ``similarity``.  Rows whose vector is null, empty, zero or holds
    null or non-finite components, and rows without a label or an id, link with
    nothing and are their own component.  Vectors of unlike length compare with
    zeros for what is missing.  Equal vectors of a label are compared once and
    counted as often as they occur; a repeated id makes further rows, which
    link like any others.  An empty table gives no rows.
    """
    if not 0.5 <= similarity < 1:
        raise ValueError("similarity must be from 0.5 to below 1")
    label = F.col(label_col)
    integral = vectors.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long")
    as_is = vectors.schema[vector_col].dataType.elementType.typeName() in ("float", "double")
    takes_part = F.col(id_col).isNotNull() & label.isNotNull() & usable(vector_col) & F.coalesce(F.exists(vector_col, lambda x: x != 0), F.lit(False))
    named = vectors.select(
        F.col(id_col).alias("id"), takes_part.alias("takes_part"), (label.cast("long") if integral else F.xxhash64(label)).alias("label"),
        F.when(takes_part, F.col(vector_col) if as_is else F.transform(vector_col, lambda x: x.cast("double"))).alias("vector"))
    rows = stored(named.withColumns({
        "key": F.when(F.col("takes_part"), F.concat_ws(":", F.hex(F.xxhash64("label", "vector")), F.hex(F.xxhash64(F.lit(1), "vector", "label")))),
        "row": F.monotonically_increasing_id()}), "rows")
    nodes = stored(rows.filter("takes_part").groupBy("key", "label", "vector").agg(
        F.count("*").alias("copies"), F.min("id").alias("least"), F.min("row").alias("node")), "nodes")
    links, edges = linked_nodes(nodes, similarity)
    reached = components(edges)
    known = stored(nodes.select("node", "key", "copies", "least").join(links, "node", "left").join(reached, "node", "left").select(
        "key", "copies", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "known")
    roots = known.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    classes = spread_join(known.select("key", "copies", "n_links", "root"), roots.select("root", "component"), "root",
                          heavy_keys(roots, "root", "n", rows_per_task), ["key"])
    classes = stored(classes.select("key", "copies", "n_links", "component"), "classes")
    found = spread_join(rows.filter("takes_part").select("id", "row", "key"), classes.select("key", "n_links", "component"), "key",
                        heavy_keys(classes, "key", "copies", rows_per_task), ["row"])
    alone = rows.filter("NOT takes_part").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return found.select("id", "n_links", "component").unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
