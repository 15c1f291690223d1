"""Reposts and superseded ads.

No operator here collects a group: reposts are reduced on the map side before
they are shuffled, and the newest ad of a group is found by an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import nfkc
from ..schemas import POST_ORDER
from .skew import dealt
from .staging import computed_once


def text_key(c: Column) -> Column:
    """Letters and digits of a text alone, folded and in lower case."""
    return F.regexp_replace(F.lower(nfkc(c)), r"[^\p{L}\p{N}]+", "")


def with_repost_key(df: DataFrame, dealer: str, message: str) -> DataFrame:
    """Add ``dedup_key``; rows whose message has no letter or digit are dropped.

    The key is the SHA-256 of "dealer|message", so that long messages are
    neither shuffled nor sorted twice.
    """
    keyed = computed_once(df, _dealer=text_key(F.col(dealer)), _message=text_key(F.col(message)))
    return (
        keyed.filter(F.col("_message") != "")
        .withColumn("dedup_key", F.sha2(F.concat_ws("|", "_dealer", "_message"), 256))
        .drop("_dealer", "_message")
    )


def earliest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key group by ``order``.

    A row number compared with 1 becomes a group limit in Spark: each map task
    keeps one row per key before the shuffle, so a hot key costs one row a task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


# Most bytes of rows that a task of `nearly_earliest_per` holds.
BYTES_HELD = 128 * 2**20


def _first_rows(held: list[pa.RecordBatch], key: str, order: Sequence[str]) -> pa.Table:
    """The first row of every ``key`` by ``order``; nulls come first, as in Spark."""
    table = pa.Table.from_batches(held).combine_chunks()
    at = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (key, *order)], null_placement="at_start")
    keys = table[key].take(at)
    begins = pc.not_equal(keys[1:], keys[:-1])
    return table.take(at.filter(pa.chunked_array([pa.array([True]), *begins.chunks])))


def nearly_earliest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], bytes_held: int = BYTES_HELD) -> DataFrame:
    """``earliest_per`` for streams, which allow no windows: the first row of every key group of a batch is left, and few others.

    Rows are dealt out by key.  A task holds the first rows it has met; where
    they are more than ``bytes_held`` it passes them on and begins anew, so a
    key may come again, and what follows must still take the first.
    """
    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= bytes_held:
                held = _first_rows(held, "_key", order).to_batches()
                size = sum(b.nbytes for b in held)
                if size >= bytes_held / 2:
                    yield from held
                    held, size = [], 0
        if held:
            yield from _first_rows(held, "_key", order).to_batches()

    # a null is told from an empty text
    parts = [F.coalesce(F.concat(F.lit("="), F.sha2(F.col(k).cast("string"), 256)), F.lit("-")) for k in keys]
    keyed = dealt(df.withColumn("_key", F.unhex(F.sha2(F.concat(*parts), 256))), "_key")
    return keyed.mapInArrow(reduced, keyed.schema).drop("_key")


def keep_earliest(posts: DataFrame) -> DataFrame:
    """Keep the earliest post of every (dealer, message); a tie goes to the first in post order."""
    return earliest_per(with_repost_key(posts, "dealer", "full_message"), ["dedup_key"], ["ts", *POST_ORDER])


def parsed_date(c: Column) -> Column:
    return F.try_to_date(c, "dd/MM/yy")


def consolidate(listings: DataFrame) -> DataFrame:
    """Merge reposts of extracted listings.

    The fields of the latest post remain, with the date of the first and the
    number of posts in ``times_posted``.  ``first_post`` tells when the ad was
    first met and orders the result.
    """
    keyed = with_repost_key(listings, "posted_by", "full_message")
    moment = F.struct(parsed_date(F.col("date")).alias("day"), *POST_ORDER)
    kept = [c for c in listings.columns if c not in ("date", "times_posted")]
    merged = keyed.groupBy("dedup_key").agg(
        F.max_by(F.struct(*kept), moment).alias("latest"),
        F.min_by("date", moment).alias("date"),
        F.count("*").cast("int").alias("times_posted"),
        F.min(moment).alias("first_post"),
    )
    return merged.select("dedup_key", "latest.*", "date", "times_posted", "first_post")


def flag_superseded(df: DataFrame, by: Sequence[str] = ("ts", *POST_ORDER), id_column: str = "dedup_key") -> DataFrame:
    """Add ``is_duplicate``: true unless the ad is the newest of its society and dealer.

    The id of each group's newest ad comes from an aggregate and is joined
    back on the id.  That key is unique on both sides, so even a group with a
    third of all ads is spread evenly; a window would sort it in one task.
    The input is read twice: pass a stored table, not a long plan.
    """
    newest = df.groupBy("society", "dealer").agg(F.max_by(id_column, F.struct(*by)).alias(id_column)).select(
        id_column, F.lit(True).alias("_newest")
    )
    return df.join(newest, id_column, "left").withColumn("is_duplicate", F.col("_newest").isNull()).drop("_newest")
