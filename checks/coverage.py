"""Operators that the other checks leave out: schema, registry files, versions, order, SQL functions, every registered name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import brickledger as b
from brickledger.functions import text as T
from brickledger.operators.ranking import numbered
from brickledger.operators.storage import new_path, stored
from brickledger.operators.dedup import keep_earliest
from brickledger.plans.views import register_functions, register_views

from .ads import CUSTOM, REGISTRY
from .inputs import CHAT_WITH, KEPT_WITH, SOCIETY, ads, ads_with, chat_tables, messages, table
from .inventory import SUMMARY, inventory, listings
from .registry import check

NAMES = REGISTRY.names()
# names whose own spelling no text rule knows: they are found as a name, not in a text
NOT_IN_TEXTS = ["PURI DIPLOMACTIC", "GODREJ MERIDIAN", "DIPLOMACTIC GREEN NEW", "ATS TRIMPH", "INDIA BULLS HIGHTS"]


@check("s2_checked_schema", f"""{CHAT_WITH}
    SELECT chat_row_id AS chat_id, true AS supported, false AS without_jid, count(*) AS n FROM message GROUP BY 1""")
def s2(spark, sf):
    tables = chat_tables(spark, sf)
    named = {"CHAT": tables.chat, "message": tables.message, "Jid": tables.jid}
    report, partial = b.inspect_schema(named), b.inspect_schema({k: v for k, v in named.items() if k != "Jid"})
    checked = b.as_chat_tables(named)
    return b.count_messages(checked).select(
        "chat_id", F.lit(report.is_supported).alias("supported"), F.lit(partial.is_supported).alias("without_jid"),
        F.col("message_count").alias("n"))


@check("s5_projects_from_file", f"""{ads_with()}
    SELECT message_id, CASE ck % 6 WHEN 4 THEN 'MAPLE RESIDENCY' WHEN 5 THEN 'LAKE ORCHID' ELSE project END AS project FROM ads""")
def s5(spark, sf):
    path = new_path(spark, "projects")
    b.write_registry(spark, CUSTOM, path)
    registry = b.read_registry(spark, path)
    return ads(spark, sf).select("message_id", registry.canonical_in_text(F.col("text")).alias("project"))


@check("d8_cache_versions", f"""{ads_with()}
    SELECT version, count(DISTINCT text) AS texts FROM ads, (VALUES ('one'), ('two')) AS v(version) GROUP BY version""")
def d8(spark, sf):
    cache, posts = new_path(spark, "cache"), messages(spark, sf)
    for version in ("one", "two", "one"):
        b.extract_once(posts, REGISTRY, cache, version)
    entries = spark.read.parquet(cache)
    return entries.groupBy(F.substring_index("version", "-", 1).alias("version")).agg(F.count("*").alias("texts"))


def placed(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of ``df`` with the place of each row in the order that ``df`` has."""
    kept = stored(df.select(*columns).withColumns({"_at": F.monotonically_increasing_id(), "_all": F.lit(0)}))
    return numbered(kept, ["_all"], ["_at"], "place").select(*columns, F.col("place").cast("int").alias("place"))


@check("o1_order_of_posts", f"""{KEPT_WITH}
    SELECT message_id, CAST(row_number() OVER (ORDER BY ts, chat_id, message_id) AS INTEGER) AS place FROM flagged WHERE society = 'SOBHA CITY'""")
def o1(spark, sf):
    return placed(b.rows_for_project(inventory(spark, sf), "SOBHA CITY"), "message_id")


@check("o2_order_of_managed_listings", f"""{KEPT_WITH}
    SELECT message_id, CAST(row_number() OVER (ORDER BY ts DESC, chat_id DESC, message_id DESC) AS INTEGER) AS place FROM flagged
    WHERE status = 'IN'""")
def o2(spark, sf):
    return placed(b.in_listings(inventory(spark, sf)), "message_id")


@check("o5_curated_names_with_custom_ones", f"""{KEPT_WITH}, names AS (SELECT * FROM (VALUES {", ".join(
    f"({i}, '{name}')" for i, name in enumerate([*NAMES, "MAPLE RESIDENCY", "LAKE ORCHID"]))}) AS t(ord, society)),
    counted AS (SELECT society, {SUMMARY} FROM kept WHERE status = 'IN' GROUP BY society)
    SELECT ord, n.society, coalesce(total_listings, 0) AS total_listings FROM names n LEFT JOIN counted USING (society)""")
def o5(spark, sf):
    return b.curated_summaries(listings(spark, sf), CUSTOM).select("ord", "society", "total_listings")


BOLD = "".join(chr(0x1D400 + i) for i in range(52)) + "".join(chr(0x1D7CE + i) for i in range(10))
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@check("t1_styled_letters", f"{ads_with()} SELECT message_id, text AS folded, {SOCIETY} AS society FROM ads")
def t1_styled(spark, sf):
    styled = ads(spark, sf).withColumn("text", F.translate("text", PLAIN, BOLD))
    folded = styled.select("message_id", "text", T.fold_text(F.col("text")).alias("folded"))
    society = b.to_inventory_rows(b.extract_listings(messages_of(styled), REGISTRY, count_posts=False), REGISTRY).select("message_id", "society")
    return folded.drop("text").join(society, "message_id")


def messages_of(rows: DataFrame) -> DataFrame:
    return rows.select("chat_id", "message_id", "timestamp_ms", "sender", "text")


@check("d2_long_texts", r"""
    SELECT message_id FROM (SELECT doc_id AS message_id, row_number() OVER (
        PARTITION BY source, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'), doc_id % 3 ORDER BY doc_id % 7, doc_id) AS nth
      FROM documents) WHERE nth = 1""")
def d2_long(spark, sf):
    # texts that differ after more than 2,000 characters only are two ads
    opening = F.repeat(F.lit("a quiet lane with trees, "), 100)
    posts = table(spark, sf, "documents").select(
        F.col("source").alias("dealer"), F.concat(opening, "text", F.lit(" no "), (F.col("doc_id") % 3).cast("string")).alias("full_message"),
        (F.col("doc_id") % 7).alias("ts"), F.lit(1).alias("chat_id"), F.col("doc_id").alias("message_id"), F.lit(0).alias("part_no"))
    return keep_earliest(posts).select("message_id")


NAME_LIST = ", ".join(f"'{n}'" for n in NAMES)


@check("r3_every_name_in_texts", f"""{ads_with()}
    SELECT message_id, CASE WHEN name IN ({", ".join(f"'{n}'" for n in NOT_IN_TEXTS)}) THEN '' ELSE name END AS project
    FROM (SELECT message_id, [{NAME_LIST}][ck % {len(NAMES)} + 1] AS name FROM ads)""")
def r3_all(spark, sf):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("ck") % len(NAMES) + 1).cast("int"))
    text = F.concat(F.lit("two flats in "), F.lower(name), F.lit(", tower "), "rooms", F.lit(" near the lake"))
    return ads(spark, sf).select("message_id", REGISTRY.canonical_in_text(text).alias("project"))


@check("r4_every_name", f"{ads_with()} SELECT message_id, [{NAME_LIST}][ck % {len(NAMES)} + 1] AS project FROM ads")
def r4_all(spark, sf):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("ck") % len(NAMES) + 1).cast("int"))
    return ads(spark, sf).select("message_id", REGISTRY.canonical_name(F.initcap(name)).alias("project"))


@check("sql_views_and_functions", f"""{KEPT_WITH}
    SELECT society, status, {SUMMARY}, lower(society) AS folded FROM kept GROUP BY society, status""")
def sql_surface(spark, sf):
    register_functions(spark)
    register_views(inventory(spark, sf), REGISTRY, prefix="check_")
    styled = f"translate(lower(society), '{PLAIN}', '{BOLD}')"
    return spark.sql(f"SELECT *, nfkc({styled}) AS folded FROM check_project_summaries")
