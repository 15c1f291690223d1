"""Mixing sources to target token weights by entropy balancing.

Every document starts with rate 1.  Among all rates between 0 and ``cap``
whose token sums meet the targets of the sources, those nearest to 1 by
relative entropy are ``min(cap, exp(l * size))`` with one multiplier ``l`` per
source.  The multipliers solve a convex dual; guarded Newton steps find them,
each from one distributed aggregate.  Rates are then rounded into copies.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import stored
from .common import Steps

TOLERANCE = 1e-9  # of a source's token sum against its target
MOST_STEPS = 80
RANKED_ROWS = 256  # rows that are ranked together for their extra copy
BROADCAST_ROWS = 500_000  # of the copies table, at some 60 bytes; larger ones are joined by shuffle


def key_of(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def capped_targets(weights: DataFrame, share: float, cap: float) -> DataFrame:
    """Add ``target`` to ``weights(source, weight, source_size)``.

    ``share`` of all tokens is dealt out by weight.  A source stops at ``cap``
    times its size; the excess is dealt to the others by weight until none is
    above its stop.  Each round is one aggregate over one row per source.
    """
    stop = F.col("source_size") * F.lit(float(cap))
    total = weights.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = stop <= F.col("weight") * F.lit(level)
        row = weights.agg(
            F.sum(F.when(full, stop)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, True)).alias("n")).first()
        if row["n"] == stopped or not row["weight"]:
            break
        level, stopped = (share * total - (row["held"] or 0.0)) / row["weight"], row["n"]
    level = math.inf if not row["weight"] else level
    return weights.withColumn("target", F.least(stop, F.col("weight") * F.lit(level)) if math.isfinite(level) else stop)


def multipliers(histogram: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``(key, mean, l)``: the multiplier of each source, for sizes in units of the source's mean.

    ``histogram(key, size, n)`` counts documents by size; ``targets`` has
    ``(key, source_size, target)``.  Steps are Newton's on the logarithm of
    the token sum, halved back into a bracket whenever they leave it.
    """
    spark = histogram.sparkSession
    sized = histogram.filter("size > 0")
    spans = sized.groupBy("key").agg(F.sum("n").alias("docs"), F.min("size").alias("least"))
    start = targets.join(spans, "key").select(
        "key", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("l"),
        # beyond hi every rate is at the cap
        F.when(F.col("target") < F.col("source_size"), 0.0).otherwise(
            F.lit(math.log(cap)) * F.col("source_size") / F.col("docs") / F.col("least") + 1e-9).alias("hi"),
        F.when(F.col("target") < F.col("source_size"), F.lit(None).cast("double")).otherwise(0.0).alias("lo"),
        (F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12))).alias("done"))
    start = start.withColumn("l", F.when(F.col("done"), F.col("hi")).otherwise(F.col("l")))
    steps = Steps(spark, "newton")
    state = steps.keep(start)
    x = F.col("size") / F.col("mean")
    tilted = F.exp(F.least(F.col("l") * x, F.lit(math.log(cap))))
    moves = F.col("l") * x < math.log(cap)
    for _ in range(MOST_STEPS):
        sums = sized.join(state.filter(~F.col("done")).select("key", "mean", "l"), "key").groupBy("key").agg(
            F.sum(F.col("n") * F.col("size") * tilted).alias("sum"),
            F.sum(F.when(moves, F.col("n") * F.col("size") * x * tilted).otherwise(0.0)).alias("slope"))
        met = F.abs(F.col("sum") - F.col("target")) <= TOLERANCE * F.col("target")
        low = F.when(F.col("sum") < F.col("target"), F.col("l")).otherwise(F.col("lo"))
        high = F.when(F.col("sum") >= F.col("target"), F.col("l")).otherwise(F.col("hi"))
        newton = F.col("l") - F.col("sum") * F.log(F.col("sum") / F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("sum") > 0) & (newton < F.col("high")) & (F.col("low").isNull() | (newton > F.col("low")))
        halved = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        running = ~F.col("done") & F.col("sum").isNotNull()
        state = steps.keep(
            state.join(sums, "key", "left").withColumns({"low": low, "high": high})
            .select("key", "target", "mean",
                    F.when(running & ~met, F.when(inside, newton).otherwise(halved)).otherwise(F.col("l")).alias("l"),
                    F.when(running, F.col("high")).otherwise(F.col("hi")).alias("hi"),
                    F.when(running, F.col("low")).otherwise(F.col("lo")).alias("lo"),
                    (~running | met).alias("done")))
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("key", "mean", "l")


def rounded(histogram: DataFrame, cap: int) -> DataFrame:
    """``(key, size, base, extra, n)``: copies of each document, and how many of ``n`` get one more.

    Within a source sizes go from large to small, and each takes the number of
    copies, between its rates rounded down and up, that brings the running
    token sum nearest to the exact one.  Where that leaves a source too far
    off, as with a handful of documents, the largest sizes that fit into the
    rest get or lose further copies.  A source has one row per distinct size
    here, however many documents it has.
    """
    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False)
        sizes, counts = group["size"].tolist(), group["n"].tolist()
        wanted = taken = 0.0
        copies = []
        for size, n, rate in zip(sizes, counts, group["rate"]):
            wanted += size * n * rate
            near = n * rate if size == 0 else (wanted - taken) / size
            floor = min(int(rate), cap)
            copies.append(min(max(round(near), n * floor), n * min(floor + 1, cap)))
            taken += size * copies[-1]
        for i, (size, n) in enumerate(zip(sizes, counts)):
            if size:
                more = min(max(int((wanted - taken) / size), -copies[i]), n * cap - copies[i])
                copies[i] += more
                taken += size * more
        return group.assign(base=[k // n for k, n in zip(copies, counts)], extra=[k % n for k, n in zip(copies, counts)])[
            ["key", "size", "base", "extra", "n"]]
    return histogram.groupBy("key").applyInPandas(fold, "key string, size long, base int, extra long, n long")


def mix(docs: DataFrame, size: Column, targets_of, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        share: float = 1.5, cap: int = 2, keep: list[str] | None = None) -> DataFrame:
    """``(row, size, source_size, target, copies)`` of every document; ``row`` is a struct of its columns, or of ``keep``.

    ``targets_of`` makes ``(source, weight, source_size)`` from ``(source,
    source_size)``.  Copies lie between 0 and ``cap``.  Null sources are one
    source, null texts and texts of size 0 keep one copy, and a source without
    any token has target 0.  Rows that are equal in all respects, and null or
    repeated ids, are documents like others.  An empty table gives no rows.
    Documents of equal size in a source differ only by hash, so reruns agree.
    """
    columns = keep if keep is not None else docs.columns
    sized = docs.select(
        F.struct(*columns).alias("row"), key_of(F.col(source_col)).alias("key"), F.col(source_col).alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.xxhash64(id_col, text_col).alias("order"))
    histogram = stored(sized.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = stored(histogram.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    targets = targets_of(sources.select("source", "source_size"))
    targets = stored(capped_targets(targets, share, cap).withColumn("key", key_of(F.col("source"))), "targets")
    tilt = multipliers(histogram, targets, cap)
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("l") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))))
    rates = histogram.join(tilt, "key", "left").select("key", "size", "n", F.when(F.col("l").isNull(), 1.0).otherwise(rate).alias("rate"))
    copies = stored(
        rounded(rates, cap).join(targets.select("key", "source_size", "target"), "key"), "copies")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    blocks = F.ceil(F.col("n") / RANKED_ROWS)
    dealt = sized.drop("source").join(copies, ["key", "size"]).withColumn("block", F.pmod(F.xxhash64("order"), blocks))
    block = Window.partitionBy("key", "size", "block")
    # a size with one block gets exactly its extra copies; larger ones their share in each block, rounded by a coin of the block
    coin = F.when(blocks == 1, 0.5).otherwise(F.pmod(F.xxhash64("key", "size", "block", F.lit(1)), F.lit(1 << 30)) / float(1 << 30))
    here = F.floor(F.count("*").over(block) * (F.col("extra") / F.col("n")) + coin)
    place = F.row_number().over(block.orderBy("order"))
    return dealt.withColumn("copies", F.col("base") + (place <= here).cast("int")).select("row", "size", "source_size", "target", "copies")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixture itself: every document as often as its copies say."""
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def cyclic_weights(cycle: tuple[float, ...]):
    """Weights in turn, over the sources by code point with null last."""
    def targets_of(sources: DataFrame) -> DataFrame:
        # one row per source
        place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
        weight = F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int"))
        return sources.withColumn("weight", weight.cast("double"))
    return targets_of
