"""Incremental inventory from a stream of messages.

Messages may come in any order and as late as they like: the earliest post of
an ad wins whenever it arrives.  Batches become runs of a levelled table, which
may be read and compacted while the stream goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import earliest_per, flag_superseded, nearly_earliest_per, with_repost_key
from ..operators.levels import FAN, Levels, Snapshot, vacuum
from ..operators.storage import replacing, scratch, stored
from ..plans.extraction import templates
from ..plans.inventory import build_listings, post_rows
from ..registry import Registry
from ..schemas import POST_ORDER


def earliest_posts_stream(messages: DataFrame, registry: Registry) -> DataFrame:
    """Streaming earliest post per ad, for a sink in ``update`` mode.

    State holds a row per ad for good: without a watermark nothing is evicted,
    since any later message may still be the earlier post.  For an inventory
    that outgrows the state store use ``stream_inventory``.

    A batch may be a single file, which one task reads; its messages are dealt
    out, since the rules cost far more than the reading.  Of equal texts by one
    sender in a batch only the earliest post can remain, so the others are left
    out before the rules.
    """
    columns = ["chat_id", "message_id", "timestamp_ms", "sender", "text"]
    first_posts = nearly_earliest_per(messages.select(*columns), ["text", "sender"], ["timestamp_ms", "chat_id", "message_id"])
    posts = with_repost_key(post_rows(templates(first_posts, registry)), "dealer", "full_message")
    fields = [c for c in posts.columns if c != "dedup_key"]
    first = F.min_by(F.struct(*fields), F.struct("ts", *POST_ORDER)).alias("first")
    return posts.groupBy("dedup_key").agg(first).select("dedup_key", "first.*")


def stream_inventory(
    source: DataFrame,
    out_path: str,
    checkpoint: str,
    registry: Registry,
    cache_path: str | None = None,
    available_now: bool = True,
    fan: int = FAN,
) -> StreamingQuery:
    """Append the ads of every micro-batch to a levelled table at ``out_path``.

    Each batch is reduced to its earliest posts and written as a run of its
    own; a repeated batch changes nothing.  ``fan`` runs of a level merge into
    one of the next, so ``read_inventory`` opens a logarithmic number of them.
    With ``cache_path`` texts of earlier batches are not parsed again.
    """
    inventory_levels(source.sparkSession, out_path, fan).open()

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = inventory_levels(spark, out_path, fan)
        with scratch(spark):
            table.append(build_listings(batch, registry, cache_path), batch_id)
        table.settle()
        vacuum(spark, out_path)

    writer = source.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def inventory_levels(spark: SparkSession, out_path: str, fan: int = FAN) -> Levels:
    """The streamed ads as a levelled table: of all posts of an ad the earliest remains."""
    return Levels(spark, out_path, "dedup_key", lambda rows: earliest_per(rows, ["dedup_key"], ["ts", *POST_ORDER]), fan)


def merged_listings(spark: SparkSession, out_path: str, at: Snapshot | None = None) -> DataFrame:
    """The earliest post of every ad, of a snapshot or of everything streamed so far."""
    return inventory_levels(spark, out_path).rows(at)


def read_inventory(spark: SparkSession, out_path: str, at: Snapshot | None = None) -> DataFrame:
    """The flagged inventory, of a snapshot or of everything streamed so far.

    Runs that have been merged stay until ``vacuum``, so a snapshot can be read
    while the stream and ``compact`` go on.
    """
    return flag_superseded(stored(merged_listings(spark, out_path, at)))


def compact(spark: SparkSession, out_path: str, target_path: str | None = None, keep_old: bool = False) -> None:
    """Fold all runs into one, or into a new table at ``target_path``.

    It may run beside the stream: batches that come meanwhile stay runs of
    their own, and until it ends, or if it is killed, the old snapshot stands.
    Unless ``keep_old`` the merged runs are deleted at the end, which ends reads
    of earlier snapshots.
    """
    if target_path and target_path != out_path:
        with replacing(spark, target_path) as staged:
            merged_listings(spark, out_path).write.parquet(f"{staged}/batch=-1")
        return
    inventory_levels(spark, out_path).compact()
    if not keep_old:
        vacuum(spark, out_path, keep=1)
