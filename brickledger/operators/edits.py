"""User edits as an overlay on an immutable inventory.

Edits and status changes are append-only tables; the latest one per listing or
society counts.  Both are reduced before they meet the inventory, which is
joined on its unique id.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import is_blank
from ..registry import Registry
from ..schemas import EDITS, INVENTORY_FIELDS, SOCIETY_STATUS
from .dedup import flag_superseded
from .storage import stored

LAST_CHAT = 2**63 - 1


def _society_key(column: str):
    return F.upper(F.trim(column))


def apply_edits(inventory: DataFrame, edits: DataFrame) -> DataFrame:
    """The inventory after updates, deletions and additions.

    An update leaves id and time as they are.  An addition is timed by its
    edit and sorts after every posted listing of the same time.  An edit of an
    id that is not there changes nothing.  A flagged inventory is flagged
    anew, since an edit can change which ad is the newest of its society and
    dealer.
    """
    resolved = edits.groupBy(F.col("id").alias("_id")).agg(
        F.max_by(F.struct("op", "row"), F.struct("edited_at", "op")).alias("_last"),
        F.min(F.when(F.col("op") == "add", F.col("edited_at"))).alias("_added_at"),
    )
    columns = [c for c in inventory.columns if c != "is_duplicate"]
    posted, changed = F.col("_posted").isNotNull(), F.col("_last").isNotNull()
    added_ms = F.unix_millis("_added_at")
    own = {"dedup_key": F.col("_id"), "ts": added_ms, "chat_id": F.lit(LAST_CHAT), "message_id": added_ms, "part_no": F.lit(0)}

    def value(column: str):
        if column in INVENTORY_FIELDS:
            return F.when(changed, F.col(f"_last.row.{column}")).otherwise(F.col(column))
        return F.when(posted, F.col(column)).otherwise(own.get(column, F.lit(None)))

    joined = inventory.select(*columns).withColumn("_posted", F.lit(True)).join(
        resolved, F.col("dedup_key") == F.col("_id"), "full_outer")
    kept = joined.filter((posted | F.col("_added_at").isNotNull()) & (~changed | (F.col("_last.op") != "delete")))
    edited = kept.select(*[value(c).alias(c) for c in columns])
    return flag_superseded(stored(edited)).select(*inventory.columns) if "is_duplicate" in inventory.columns else edited


def update_listing(listings: DataFrame, edited_at: dt.datetime) -> DataFrame:
    """Edits that replace the fields of ``listings`` (``dedup_key`` and the inventory fields)."""
    return listings.select(
        F.col("dedup_key").alias("id"), F.lit("update").alias("op"), F.lit(edited_at).alias("edited_at"),
        F.struct(*INVENTORY_FIELDS).alias("row"),
    )


def delete_listing(ids: DataFrame, edited_at: dt.datetime) -> DataFrame:
    """Edits that delete the listings named in the ``dedup_key`` column."""
    no_row = F.struct(*[F.lit(None).cast("string").alias(f) for f in INVENTORY_FIELDS])
    return ids.select(
        F.col("dedup_key").alias("id"), F.lit("delete").alias("op"), F.lit(edited_at).alias("edited_at"),
        no_row.alias("row"),
    )


def new_listing(rows: DataFrame, registry: Registry, edited_at: dt.datetime) -> DataFrame:
    """Edits that add listings typed in by hand.

    A blank message is composed from the other fields, a blank status follows
    the registry.  The id is derived from content and time, so a retried task
    gives the same one.
    """
    parts = [F.col(c) for c in ("society", "acco", "area", "floor", "price", "dealer", "phone")]
    composed = F.array_join(F.filter(F.array(*parts), lambda v: ~is_blank(v)), " ")
    selected = registry.is_selected(F.col("society"))
    filled = rows.withColumns({
        "full_message": F.when(F.coalesce(is_blank(F.col("full_message")), F.lit(True)), composed)
        .otherwise(F.col("full_message")),
        "status": F.when(
            F.coalesce(is_blank(F.col("status")), F.lit(True)), F.when(selected, "IN").otherwise("OUT")
        ).otherwise(F.col("status")),
        "_at": F.lit(edited_at),
    })
    identity = F.sha2(F.to_json(F.struct("_at", *INVENTORY_FIELDS)), 256)
    return filled.select(
        F.concat(F.lit("manual_"), identity).alias("id"), F.lit("add").alias("op"), F.col("_at").alias("edited_at"),
        F.struct(*INVENTORY_FIELDS).alias("row"),
    )


def no_edits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EDITS)


def apply_society_status(inventory: DataFrame, statuses: DataFrame) -> DataFrame:
    """The inventory with the latest status set for each society, in any spelling of case."""
    latest = statuses.groupBy(_society_key("society").alias("_key")).agg(
        F.max_by("status", F.struct("edited_at", "status")).alias("_status")
    )
    return (
        inventory.withColumn("_key", _society_key("society"))
        .join(latest, "_key", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .select(*inventory.columns)
    )


def society_status(spark: SparkSession, society: str, status: str, edited_at: dt.datetime) -> DataFrame:
    return spark.createDataFrame([(society.strip().upper(), status, edited_at)], SOCIETY_STATUS)


def _count(inventory: DataFrame, society: str, status: str) -> DataFrame:
    matches = (_society_key("society") == society.strip().upper()) & (F.col("status") == status)
    return inventory.filter(matches).agg(F.count("*").alias("listings"))


def promote_society(
    inventory: DataFrame, registry: Registry, society: str, edited_at: dt.datetime, aliases: tuple[str, ...] = ()
) -> tuple[DataFrame, Registry, DataFrame]:
    """Move a society to IN and make it a project of the registry.

    Returns the inventory, the registry and the number of its IN listings.
    """
    change = society_status(inventory.sparkSession, society, "IN", edited_at)
    promoted = apply_society_status(inventory, change)
    return promoted, registry.add(society, aliases), _count(promoted, society, "IN")


def demote_society(
    inventory: DataFrame, registry: Registry, society: str, edited_at: dt.datetime
) -> tuple[DataFrame, Registry, DataFrame]:
    """Move a society to OUT and drop it from the custom projects."""
    change = society_status(inventory.sparkSession, society, "OUT", edited_at)
    demoted = apply_society_status(inventory, change)
    return demoted, registry.remove(society), _count(demoted, society, "OUT")


def add_society(
    inventory: DataFrame, registry: Registry, society: str, aliases: tuple[str, ...], edited_at: dt.datetime
) -> tuple[DataFrame, Registry, DataFrame]:
    """Register a society under several names and promote it."""
    return promote_society(inventory, registry, society, edited_at, aliases)
