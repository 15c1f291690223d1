"""SimHash near-duplicates, searched with a Gray-order hierarchical index.

Fingerprints are sorted by their rank in the Gray code, so that neighbours
share most bits.  Groups of neighbours become nodes of a tree; the bits that a
whole group shares move up into the node, and each child keeps only what its
parent does not state yet.  A search adds up the differences on its way down
and leaves out a group as soon as the sum passes the limit.

The top of the tree is built over blocks of sorted fingerprints and is all
that is broadcast; its size is bounded by ``MAX_BLOCKS``.  Each block's own
tree is built in the task that searches it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import new_path, remove, scratch, stored
from .common import batches, components, utf8, whole_texts, words

BITS = 64
HASH_SEED = 42
FAN_OUT = 8
BLOCK_ROWS = 1024
MAX_BLOCKS = 65_536  # 16 bytes each: the broadcast tree stays below 3 MB
BLOCKS_PER_CHUNK = 64  # a search task sees at most this many blocks of visitors
QUERIES_AT_ONCE = 4096


# ---------------------------------------------------------------- fingerprints

def shingles(text: bytes | None, width: int) -> list[bytes]:
    """Runs of ``width`` words; a text of fewer words is one shingle, an empty one has none."""
    w = words(text)
    if len(w) < width:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(width)))))


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    made = [xxhash.xxh64_digest(s, HASH_SEED) for s in shingles(text, width)]
    return np.frombuffer(b"".join(made), dtype=">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in more than half of the hashes; no hashes give 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        octets = np.ascontiguousarray(hashes[start:start + (1 << 16)]).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)``: the fingerprint of every whole text, as a signed long with the same 64 bits.

    Shingles count as often as they occur.  Null and empty texts get 0.  Rows
    with a null id or with repeated ids stay as they are.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["id", "fp"])
    source = whole_texts(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    return source.mapInArrow(batches(run), "id long, fp long")


# ----------------------------------------------------------------- the index

def gray_rank(c: Column) -> Column:
    """Place of a fingerprint in the Gray code, shifted so that signed order is its order."""
    for step in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, step))
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    for step in (1, 2, 4, 8, 16, 32):
        fps = fps ^ (fps >> np.uint64(step))
    return fps


class GrayTree:
    """The tree over leaves in Gray order.  ``ands`` and ``ors`` are equal for leaves that are one fingerprint."""

    def __init__(self, ands: np.ndarray, ors: np.ndarray):
        levels = [(ands, ors)]
        while len(levels[-1][0]) > FAN_OUT:
            a, o = levels[-1]
            starts = np.arange(0, len(a), FAN_OUT)
            levels.append((np.bitwise_and.reduceat(a, starts), np.bitwise_or.reduceat(o, starts)))
        self.levels = []
        for depth, (a, o) in enumerate(levels):
            shared = ~(a ^ o)
            own = shared
            if depth + 1 < len(levels):
                above = ~(levels[depth + 1][0] ^ levels[depth + 1][1])
                own = shared & ~np.repeat(above, FAN_OUT)[: len(a)]
            self.levels.append((a & own, own))

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) whose known differences are at most ``limit``."""
        if not len(queries) or not len(self.levels[0][0]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = len(self.levels[-1][0])
        q, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        differ = np.zeros(len(q), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, own = self.levels[depth]
            differ = differ + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
            keep = differ <= limit
            q, node, differ = q[keep], node[keep], differ[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                child = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                real = child < below
                q, node, differ = np.repeat(q, FAN_OUT)[real], child[real], np.repeat(differ, FAN_OUT)[real]
        return q, node


def smallest_labels(n: int, pairs) -> np.ndarray:
    """Label of each of ``n`` nodes: the smallest node it is connected to by ``pairs``, an iterator of arrays."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            least = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            while not np.array_equal(label, label[label]):
                label = label[label]
            if np.array_equal(before, label):
                break
    return label


def links(fps: DataFrame, limit: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b)``: edges that connect all fingerprints with at most ``limit`` differing bits, for ``fps(fp)``.

    Every such pair is found; what a task found is returned as edges to the
    smallest fingerprint of each connected set, so dense sets do not grow
    quadratically.  Equal fingerprints are one node.
    """
    spark = fps.sparkSession
    distinct = stored(fps.select("fp").distinct().withColumn("gray", gray_rank(F.col("fp"))), "gray")
    blocks = int(min(MAX_BLOCKS, max(1, distinct.count() // block_rows)))
    placed = stored(distinct.repartitionByRange(blocks, "gray").select("fp", F.spark_partition_id().alias("part")), "blocks")
    nodes = placed.groupBy("part").agg(F.bit_and("fp").alias("ands"), F.bit_or("fp").alias("ors")).orderBy("part").toPandas()
    ands, ors = nodes["ands"].to_numpy(np.int64).view(np.uint64), nodes["ors"].to_numpy(np.int64).view(np.uint64)
    place = np.zeros(int(nodes["part"].max()) + 1 if len(nodes) else 1, np.int64)
    place[nodes["part"].to_numpy(np.int64)] = np.arange(len(nodes))
    top = spark.sparkContext.broadcast((place, ands, ors))

    def route(source):
        place, ands, ors = top.value
        tree, shared = GrayTree(ands, ors), ~(ands ^ ors)
        chunks: dict[int, np.ndarray] = {}

        def chunks_of(block: int) -> np.ndarray:
            """Chunks of later blocks that can hold a partner of this block, and its own chunk."""
            if block not in chunks:
                apart = np.bitwise_count((ands ^ ands[block]) & shared & shared[block])
                later = np.flatnonzero(apart <= limit)
                chunks[block] = np.unique(np.append(later[later >= block], block) // BLOCKS_PER_CHUNK)
            return chunks[block]

        for batch in source:
            fp = batch.column(0).to_numpy().view(np.uint64)
            own = place[batch.column(1).to_numpy()]
            for start in range(0, len(fp), QUERIES_AT_ONCE):
                f, home = fp[start:start + QUERIES_AT_ONCE], own[start:start + QUERIES_AT_ONCE]
                q, target = tree.search(f, limit)
                earlier = target < home[q]
                q, target = q[earlier], target[earlier]
                sets = [chunks_of(int(h)) for h in home]
                member = np.repeat(np.arange(len(f)), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([target, home[member]]).astype(np.int32)),
                    pa.array(np.concatenate([home[q] // BLOCKS_PER_CHUNK, *sets]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(q), bool), np.ones(len(member), bool)])),
                    pa.array(np.concatenate([f[q], f[member]]).view(np.int64)),
                ], ["block", "chunk", "member", "fp"])

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64).view(np.uint64)
        member = group["member"].to_numpy(bool)
        members, visitors = fp[member], fp[~member]
        order = np.argsort(gray_ranks(members))
        members = members[order]
        tree = GrayTree(members, members)
        # members search each other once, in the chunk of their own block
        asked = np.concatenate([members, visitors]) if key[1] == key[0] // BLOCKS_PER_CHUNK else visitors
        first = 0 if len(asked) > len(visitors) else len(members)

        def pairs():
            for start in range(0, len(asked), QUERIES_AT_ONCE):
                q, leaf = tree.search(asked[start:start + QUERIES_AT_ONCE], limit)
                yield q + start + first, leaf
        nodes = np.concatenate([members, visitors])
        rank = np.argsort(nodes.view(np.int64), kind="stable")
        back = np.empty_like(rank)
        back[rank] = np.arange(len(rank))
        label = smallest_labels(len(nodes), ((back[a], back[b]) for a, b in pairs()))
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        ordered = nodes.view(np.int64)[rank]
        return pd.DataFrame({"a": ordered[linked], "b": ordered[label[linked]]})

    routed = placed.mapInArrow(route, "block int, chunk int, member boolean, fp long")
    return routed.groupBy("block", "chunk").applyInPandas(search, "a long, b long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                           limit: int = 2) -> DataFrame:
    """``(id, fp, class)`` of every row: ``class`` is the smallest id that links of ``limit`` bits or fewer reach.

    One row for every row of ``docs``, repeated ids and equal texts included.
    Rows with a null id have a class like others, but no class is named by
    a null unless all its ids are null.  An empty table gives no rows.
    """
    marked = stored(with_fingerprints(docs, id_col, text_col, width), "fingerprints")
    roots = components(links(marked, limit))
    named = (
        marked.groupBy("fp").agg(F.min("id").alias("least"))
        .join(roots, F.col("fp") == F.col("node"), "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    named = stored(named, "roots")
    classes = named.join(named.groupBy("root").agg(F.min("least").alias("class")), "root").select("fp", "class")
    return marked.join(classes, "fp").select("id", "fp", "class")


# ------------------------------------------------- near copies by word shingles

SKETCHES = 32
SKETCH_SHINGLES = 5
_seeds = np.random.default_rng(5).integers(0, 1 << 63, SKETCHES, dtype=np.uint64)


def sketch_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHash of each of ``SKETCHES`` consistent samples of a shingle set.

    A sample is the ``SKETCH_SHINGLES`` shingles that come first in an order of
    its own, so two large sets with a similarity of 0.8 share a given sample with
    probability 0.33, and miss all of them once in 300,000 pairs.  Of small sets
    fewer samples are shared (0.31 at 40 of 50 shingles, none at 4 of 5), so
    ``rare_shingles`` makes the candidates of those.
    """
    if not len(hashes):
        return np.zeros(SKETCHES, np.uint64)
    x = hashes[None, :].astype(np.uint64) ^ _seeds[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    n = min(SKETCH_SHINGLES, len(hashes))
    first = np.sort(np.partition(x, n - 1, axis=1)[:, :n], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(first.astype(">u8")).view(np.uint8).reshape(SKETCHES, n, 8), axis=2)
    fps = np.packbits(2 * bits.sum(axis=1, dtype=np.int64) > n, axis=1).view(">u8").ravel().astype(np.uint64)
    return fps ^ _seeds  # equal bits in different samples are no match


SMALL_SET = 40  # pairs with a set of at most so many shingles are found for certain


def rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """``(node, shingle, size, reach)`` such that similar sets of ``sets(node, shingles)`` have a shingle in common, for certain.

    Prefix filtering: a set of n shingles has ``similarity * n`` or more in common
    with any that is similar, so all but those less one can be left out, and in
    one order of all shingles both keep the first that they share.  The order is
    by number of sets, so that a common passage makes no groups; shingles of
    one set take their places in it but are no keys.

    ``reach`` is the largest ``size`` of a similar set of which this is the first
    shared shingle: nothing before it is shared, so they have at most what
    follows in common, and need ``similarity`` of their union.
    """
    single = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    shared = stored(single.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1"), "shared")
    met = single.join(small_if_counted(shared), "shingle")
    place = F.row_number().over(Window.partitionBy("node").orderBy("sets", "shingle"))
    alone = F.col("size") - F.count("*").over(Window.partitionBy("node"))
    kept = F.col("size") - F.ceil(F.col("size") * similarity - ROUNDING) + 1
    both = (F.col("size") - F.col("place") + 1) * ((1 + similarity) / similarity + ROUNDING)
    placed = met.withColumn("place", place + alone).filter(F.col("place") <= kept)
    return placed.select("node", "shingle", "size", F.floor(both - F.col("size")).alias("reach"))


def with_partners(members: DataFrame) -> DataFrame:
    """Rows of ``members(key, size, reach, ...)`` that can be similar to another of their group by first sharing its key.

    Of two that can, the smaller reaches its own size, and the larger reaches
    the smaller.  So the copies of a text that have too many shingles of their
    own to be similar to each other leave its groups, without a comparison.
    """
    least = members.filter("reach >= size").groupBy("key").agg(F.min("size").alias("least"))
    near = stored(members.join(least, "key").filter("reach >= least").select(members.columns), "near")
    return near.join(near.groupBy("key").agg(F.count("*").alias("count")).filter("count > 1"), "key")


BROADCAST_ROWS = 300_000  # of a table of nodes, some 30 MB; larger ones are joined by shuffle


def small_if_counted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def texts_with_company(source: DataFrame, width: int, similarity: float, limit: int) -> DataFrame:
    """``(node)`` of the texts of ``source(node, text)`` that may have a near copy.

    These share a sample fingerprint with another text, or a whole-text
    fingerprint that the Gray index links at ``limit`` bits, or they are small
    enough to be similar to a set of ``SMALL_SET`` shingles, or have none.
    """
    partner = int(SMALL_SET / similarity + ROUNDING)  # the largest set that is similar to a small one

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole, samples, small = [], [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(text, width)
            distinct = np.unique(hashes).astype(np.uint64)
            whole.append(fingerprint(hashes))
            small.append(len(distinct) <= partner)
            samples.append(sketch_fingerprints(distinct).view(np.int64) if len(distinct) > SMALL_SET else [])
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(np.array(whole, np.uint64).view(np.int64), pa.int64()), pa.array(samples, pa.list_(pa.int64())),
            pa.array(small, pa.bool_())], ["node", "fp", "samples", "small"])

    described = source.mapInArrow(batches(describe), "node string, fp long, samples array<long>, small boolean")
    described = stored(described.dropDuplicates(["node"]), "described")
    sampled = described.filter(F.size("samples") > 0)
    roots = components(links(sampled, limit)).select(F.col("node").alias("fp"), "root")
    by_index = sampled.join(roots, "fp", "left").select("node", F.xxhash64(F.coalesce("root", "fp"), F.lit("whole")).alias("key"))
    keys = sampled.select("node", F.explode("samples").alias("key")).union(by_index)
    shared = stored(keys.groupBy("key").count().filter("count > 1").select("key"), "shared")
    found = keys.join(small_if_counted(shared), "key", "left_semi").select("node")
    return found.union(described.filter("small").select("node")).distinct()


def similar_links(texts: DataFrame, width: int, similarity: float, limit: int) -> DataFrame:
    """``(a, b)``: verified links between the nodes of ``texts(node, text)``; rows of one node have one text.

    Fingerprints decide which texts may have a near copy; candidate pairs are
    those of them that have one of their ``rare_shingles`` in common.  The texts of
    such a group are compared with one of them, the one that is in most and
    largest groups; those that are not similar to it are compared with the next
    two, then with four, and so on, until each is linked or was compared with
    all.  So copies cost one comparison each, however many there are, and no
    group is gathered.  Texts that by their sizes and the places of the shingle
    cannot be similar to any other of the group leave it before each round; what
    is left of a group without being similar costs the square of its number.
    """
    spark = texts.sparkSession
    source = whole_texts(texts).select("node", utf8("text").alias("text"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [np.unique(shingle_hashes(t, width)).astype(np.uint64).view(np.int64) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["node", "shingles"])

    path = new_path(spark, "shingles")
    with scratch(spark):
        candidates = small_if_counted(stored(texts_with_company(source, width, similarity, limit), "candidates"))
        shingled = source.join(candidates, "node", "left_semi").mapInArrow(batches(sets), "node string, shingles array<long>")
        shingled.dropDuplicates(["node"]).write.parquet(path)
    shingled = spark.read.schema("node string, shingles array<long>").parquet(path)
    none = F.lit(0).cast("long")
    empty = shingled.filter(F.size("shingles") == 0).select("node", none.alias("key"), none.cast("int").alias("size"), none.alias("reach"))
    verified, rounds = new_path(spark, "verified"), new_path(spark, "rounds")
    with scratch(spark):
        groups = stored(rare_shingles(shingled, similarity).withColumnRenamed("shingle", "key").union(empty), "groups")
        sized = stored(with_partners(groups), "sized")
        weight = sized.groupBy("node").agg(F.sum("count").alias("weight"))
        sized.join(weight, "node").select(MEMBER).write.parquet(f"{rounds}/0")
    done = 0
    while not (members := spark.read.schema(MEMBERS).parquet(f"{rounds}/{done}")).isEmpty():
        order = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
        heads = members.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 1 << done)
        heads = heads.select("key", F.col("node").alias("head"), F.col("weight").alias("head_weight"))
        later = (F.col("weight") < F.col("head_weight")) | ((F.col("weight") == F.col("head_weight")) & (F.col("node") > F.col("head")))
        with scratch(spark):
            asked = stored(members.join(heads, "key").filter(later), "asked")
            met = overlaps(asked.select("node", "head").distinct(), shingled, similarity)
            met.filter(F.col("apart") <= 2 * (1 - similarity) + ROUNDING).write.parquet(f"{verified}/{done}")
            close = spark.read.schema(VERIFIED).parquet(f"{verified}/{done}").filter("close")
            # a text goes on in a group if none of the heads is similar; those that were heads themselves have met all others
            linked = asked.join(close, ["node", "head"], "left_semi").select("key", "node")
            open_ = asked.select(MEMBER).distinct().join(linked, ["key", "node"], "left_anti")
            open_ = open_.join(heads.select("key", F.col("head").alias("node")), ["key", "node"], "left_anti")
            with_partners(stored(open_.select(MEMBER), "open")).select(MEMBER).write.parquet(f"{rounds}/{done + 1}")
        remove(spark, f"{rounds}/{done}")
        done += 1
    if not done:
        return spark.createDataFrame([], "a string, b string")
    met = stored(spark.read.schema(VERIFIED).parquet(*(f"{verified}/{i}" for i in range(done))).distinct(), "met")
    linked = met.filter("close").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return linked.union(links_past_heads(met, shingled, similarity)).distinct()


MEMBER = ["node", "key", "size", "reach", "weight"]
MEMBERS = "node string, key long, size int, reach long, weight long"
VERIFIED = "node string, head string, apart double, close boolean"
ROUNDING = 1e-9  # distances are sums of quotients; a bound on them is taken this much wider


def overlaps(pairs: DataFrame, shingled: DataFrame, similarity: float) -> DataFrame:
    """``pairs(node, head)`` with ``apart``, one minus their Jaccard similarity, and ``close``; two empty sets are equal."""
    compared = pairs.join(shingled, "node").join(shingled.select(F.col("node").alias("head"), F.col("shingles").alias("others")), "head")
    both = F.size(F.array_intersect("shingles", "others"))
    union = F.size("shingles") + F.size("others") - both
    apart = F.when(union == 0, 0.0).otherwise(1 - both / union)
    return compared.select("node", "head", apart.alias("apart"), (both >= F.lit(similarity) * union).alias("close"))


def links_past_heads(met: DataFrame, shingled: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links between a text and those that left its group before it, for ``met(node, head, apart, close)``.

    Of a pair that shares a group, one left it first as a copy of a head that
    the other was compared with.  Jaccard distance is a metric, so they can be
    similar only if the other is no farther from that head than both distances
    together; ``met`` has all such pairs.  Those whose texts are connected
    already need no link of their own.
    """
    copies = met.filter("close").select(F.col("node").alias("copy"), "head", F.col("apart").alias("copy_apart"))
    roots = stored(components(copies.select(F.col("copy").alias("a"), F.col("head").alias("b"))), "roots")
    of_head = roots.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    beyond = met.filter("NOT close").select("node", "head", "apart").join(of_head, "head").join(roots, "node", "left")
    beyond = stored(beyond.filter(~F.col("root").eqNullSafe(F.col("head_root"))).select("node", "head", "apart"), "beyond")
    in_reach = F.col("apart") <= F.col("copy_apart") + (1 - similarity) + ROUNDING
    pairs = beyond.join(copies, "head").filter(in_reach).select("node", F.col("copy").alias("head")).distinct()
    return overlaps(pairs, shingled, similarity).filter("close").select(F.col("node").alias("a"), F.col("head").alias("b"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8,
                limit: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest id, and all rows without any.

    Two texts are near copies if their sets of ``width``-word shingles have a
    Jaccard similarity of ``similarity`` or more; groups are what such links
    connect.  Null ids come after all others.  Rows of equal text are copies,
    so of repeated rows, and of all empty and null texts, one stays.  Whole
    texts are compared, however long.  An empty table gives no rows.  Columns
    and their values are those of ``docs``.  Tables in between are deleted
    as soon as they are not needed.
    """
    spark = docs.sparkSession
    node = F.md5(F.coalesce(utf8(text_col), F.lit(b""))).alias("node")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), node)
    path = new_path(spark, "kept")
    with scratch(spark):
        counted = docs.select(F.col(id_col).alias("id"), node).groupBy("node", "id").agg(F.count("*").alias("n"))
        first = F.struct(F.col("id").isNull(), "id")
        nodes = counted.groupBy("node").agg(F.min_by(F.struct("id", "n"), first).alias("best")).select("node", "best.*")
        texts = docs.select(node, F.col(text_col).alias("text"))
        roots = components(similar_links(texts, width, similarity, limit))
        grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        kept = grouped.groupBy("root").agg(F.min_by(F.struct("node", "id", "n"), F.struct(F.col("id").isNull(), "id", "node")).alias("kept"))
        kept = kept.select(F.col("kept.node").alias("node"), F.col("kept.id").alias("kept_id"), "kept.n")
        kept.write.parquet(path)
    kept = spark.read.schema(kept.schema).parquet(path)
    chosen = rows.join(small_if_counted(kept), "node").filter(F.col("id").eqNullSafe(F.col("kept_id")))
    if kept.filter("n > 1").isEmpty():
        return chosen.select("row.*")
    return chosen.filter("n = 1").select("row.*").union(chosen.filter("n > 1").dropDuplicates(["node"]).select("row.*"))
