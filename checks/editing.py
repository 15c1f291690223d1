"""User edits over the inventory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

import brickledger as b
from brickledger.operators.storage import new_path, stored

from .inputs import KEPT_WITH, ads, ads_with
from .inventory import inventory, listings
from .registry import check

REGISTRY = b.Registry()
FIRST, LATER = dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 2)


@check("m1_update_listing", f"""{KEPT_WITH}
    SELECT dedup_key, ts, society, dealer, CASE WHEN sec = '9' THEN '1 CR' WHEN sec = '7' THEN 'on call' ELSE price END AS price
    FROM kept""")
def m1(spark, sf):
    rows = stored(listings(spark, sf))
    wanted = rows.filter(F.col("sec").isin("9", "7"))
    first = b.update_listing(wanted.withColumn("price", F.lit("on call")), FIRST)
    later = b.update_listing(wanted.filter("sec = '9'").withColumn("price", F.lit("1 CR")), LATER)
    return b.apply_edits(rows, later.unionByName(first)).select("dedup_key", "ts", "society", "dealer", "price")


EDITED = f"""{KEPT_WITH},
    edited AS (SELECT dedup_key, ts, chat_id, message_id, CASE WHEN society = 'SOBHA CITY' AND NOT is_duplicate THEN 'GODREJ ICON' ELSE society
        END AS society, CASE WHEN society = 'M3M CAPITAL' AND NOT is_duplicate THEN 'Somebody Else' ELSE dealer END AS dealer FROM flagged
      UNION ALL SELECT 'manual', epoch_ms(TIMESTAMP '2024-05-02'), 9223372036854775807, epoch_ms(TIMESTAMP '2024-05-02'), 'GODREJ ICON', 'Asha Verma')
    SELECT society, dealer, ts, message_id, row_number() OVER (PARTITION BY society, dealer ORDER BY ts DESC, chat_id DESC, message_id DESC) <> 1
      AS is_duplicate FROM edited"""


def edits_of(spark, rows):
    newest = rows.filter(~F.col("is_duplicate"))
    moved = b.update_listing(newest.filter("society = 'SOBHA CITY'").withColumn("society", F.lit("GODREJ ICON")), FIRST)
    handed = b.update_listing(newest.filter("society = 'M3M CAPITAL'").withColumn("dealer", F.lit("Somebody Else")), FIRST)
    typed = spark.createDataFrame([("GODREJ ICON", "IN", *[""] * 5, "Asha Verma", *[""] * 3)],
        "society string, status string, sec string, area string, acco string, floor string, flat_no string, dealer string, phone string, "
        "price string, full_message string")
    added = b.new_listing(typed, REGISTRY, LATER)
    return moved.unionByName(handed).unionByName(added)


@check("m1_flags_after_edits", EDITED)
def m1_flags(spark, sf):
    rows = inventory(spark, sf)
    return b.apply_edits(rows, edits_of(spark, rows)).select("society", "dealer", "ts", "message_id", "is_duplicate")


@check("m1_edits_by_bucket", EDITED)
def m1_buckets(spark, sf):
    path = new_path(spark, "managed")
    b.write_managed(inventory(spark, sf), path)
    edits = stored(edits_of(spark, b.read_managed(spark, path)))
    # one after the other, into the same table
    for op in ("update", "add"):
        b.edit_managed(spark, path, edits.filter(F.col("op") == op))
    return b.read_managed(spark, path).select("society", "dealer", "ts", "message_id", "is_duplicate")


@check("m2_delete_listing", f"{KEPT_WITH} SELECT dedup_key, society FROM kept WHERE status <> 'OUT'")
def m2(spark, sf):
    rows = stored(listings(spark, sf))
    return b.apply_edits(rows, b.delete_listing(rows.filter("status = 'OUT'"), FIRST)).select("dedup_key", "society")


@check("m3_add_listing", f"""{ads_with()}
    SELECT DISTINCT project || title AS society, CASE WHEN project = '' THEN 'OUT' ELSE 'IN' END AS status, name AS dealer,
      project || title || ' ' || rooms || 'BHK ' || area || ' ' || name || ' ' || mobile AS full_message,
      epoch_ms(TIMESTAMP '2024-05-01') AS ts FROM ads""")
def m3(spark, sf):
    blank = F.lit("")
    typed = ads(spark, sf).select(
        F.concat("project", "title").alias("society"), F.lit(" ").alias("status"), F.col("sector").alias("sec"),
        F.col("area"), F.concat("rooms", F.lit("BHK")).alias("acco"), blank.alias("floor"), blank.alias("flat_no"),
        F.col("name").alias("dealer"), F.col("mobile").alias("phone"), F.lit(" ").alias("price"), blank.alias("full_message"),
    ).distinct()
    rows = stored(listings(spark, sf))
    edited = b.apply_edits(rows, b.new_listing(typed, REGISTRY, FIRST))
    return edited.filter(F.col("dedup_key").startswith("manual_")).select("society", "status", "dealer", "full_message", "ts")


@check("m4_promote_society", f"""{KEPT_WITH}
    SELECT society, CASE WHEN society = 'Maple Residency Sector 5' THEN 'IN' ELSE status END AS status, count(*) AS n
    FROM kept GROUP BY 1, 2""")
def m4(spark, sf):
    promoted, _, _ = b.promote_society(listings(spark, sf), REGISTRY, " maple residency sector 5", FIRST)
    return promoted.groupBy("society", "status").agg(F.count("*").alias("n"))


@check("m5_demote_society", f"""{KEPT_WITH}
    SELECT society, CASE WHEN society = 'SOBHA CITY' THEN 'OUT' ELSE status END AS status, count(*) AS n FROM kept GROUP BY 1, 2""")
def m5(spark, sf):
    demoted, _, _ = b.demote_society(listings(spark, sf), REGISTRY, "Sobha City", FIRST)
    return demoted.groupBy("society", "status").agg(F.count("*").alias("n"))


@check("m6_add_society", f"""{KEPT_WITH}
    SELECT dedup_key, society, 'IN' AS status, count(*) OVER () AS listings FROM kept WHERE society = 'Orchid Residency Sector 12'""")
def m6(spark, sf):
    rows, registry, moved = b.add_society(listings(spark, sf), REGISTRY, "ORCHID RESIDENCY SECTOR 12", ("Orchid 12",), LATER)
    own = rows.filter(registry.is_selected(F.col("society")) & ~REGISTRY.is_selected(F.col("society")))
    return own.select("dedup_key", "society", "status").crossJoin(F.broadcast(moved))
