"""Message tables derived from the driver tables.

Each input is one SQL text that Spark and DuckDB both run, so query and
expected result always start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brickledger import ChatTables, as_chat_tables

# -- conversations as a message database ------------------------------------

CHAT_SQL = {
    "jid": """
        SELECT DISTINCT conv_id AS _id,
          CASE WHEN conv_id % 2 = 0 THEN CAST(120363000000 + conv_id AS STRING) || '@g.us'
               WHEN conv_id % 5 = 0 THEN 'user' || CAST(conv_id AS STRING) || '@s.whatsapp.net'
               ELSE CAST(15550000000 + conv_id AS STRING) || '@s.whatsapp.net' END AS raw_string,
          CASE WHEN conv_id % 2 = 0 THEN CAST(120363000000 + conv_id AS STRING)
               WHEN conv_id % 5 = 0 THEN 'user' || CAST(conv_id AS STRING)
               ELSE CAST(15550000000 + conv_id AS STRING) END AS user,
          CASE WHEN conv_id % 2 = 0 THEN 'g.us' ELSE 's.whatsapp.net' END AS server
        FROM conversations
        UNION ALL
        SELECT DISTINCT 1000000000 + conv_id % 40, CAST(15551000000 + conv_id % 40 AS STRING) || '@s.whatsapp.net',
          CAST(15551000000 + conv_id % 40 AS STRING), 's.whatsapp.net'
        FROM conversations
        UNION ALL
        SELECT DISTINCT 2000000000 + conv_id % 40, CAST(70000000000000 + conv_id % 40 AS STRING) || '@lid',
          CAST(70000000000000 + conv_id % 40 AS STRING), 'lid'
        FROM conversations
    """,
    "jid_map": """
        SELECT DISTINCT 2000000000 + conv_id % 40 AS lid_row_id, 1000000000 + conv_id % 40 AS jid_row_id
        FROM conversations WHERE conv_id % 40 < 20
    """,
    "chat": """
        SELECT conv_id AS _id, conv_id AS jid_row_id,
          CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN '  ' ELSE 'Chat no ' || CAST(conv_id AS STRING) END
            AS subject,
          MAX(turn) * 60000 + conv_id * 1000 AS sort_timestamp,
          CASE WHEN conv_id % 7 = 0 THEN NULL WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS archived
        FROM conversations GROUP BY conv_id
    """,
    "message": """
        SELECT conv_id * 1000 + turn AS _id, conv_id AS chat_row_id,
          CASE WHEN role = 'user' THEN 1000000000 + conv_id % 40 WHEN role = 'assistant' THEN 2000000000 + conv_id % 40
          END AS sender_jid_row_id,
          CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS from_me,
          CASE WHEN turn % 5 = 0 THEN NULL ELSE 'K' || CAST(conv_id * 1000 + turn AS STRING) END AS key_id,
          turn * 60000 + conv_id * 1000 AS timestamp,
          CASE turn % 7 WHEN 4 THEN 1 WHEN 5 THEN 64 WHEN 6 THEN NULL ELSE 0 END AS message_type,
          CASE WHEN turn % 7 = 5 THEN NULL ELSE text END AS text_data
        FROM conversations
    """,
}

# Sub-queries in front of an expected result, each computed once
CHAT_WITH = "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in CHAT_SQL.items())

# -- orders as property ads --------------------------------------------------

# {ms} is epoch milliseconds of o_orderdate, the one expression the dialects do not share.
AD_FIELDS_SQL = """
    SELECT o_orderkey AS ok, o_custkey AS ck, {ms} AS timestamp_ms,
      o_orderkey % 16 AS chat_id, o_orderkey AS message_id, CAST(919000000000 + o_custkey AS STRING) AS sender,
      CASE o_custkey % 6 WHEN 0 THEN 'M3M Capital' WHEN 1 THEN 'Sobha City' WHEN 2 THEN 'Godrej Icon'
        WHEN 3 THEN 'Smart World DXP' WHEN 4 THEN 'Maple Residency' ELSE 'Orchid Residency' END AS title,
      CASE o_custkey % 6 WHEN 0 THEN 'M3M CAPITAL' WHEN 1 THEN 'SOBHA CITY' WHEN 2 THEN 'GODREJ ICON'
        WHEN 3 THEN 'SMART WORLD DXP' ELSE '' END AS project,
      CASE o_custkey % 4 WHEN 0 THEN 'Asha Verma' WHEN 1 THEN 'Ravi Menon' WHEN 2 THEN 'Nila Bose' ELSE 'Omar Khan' END
        AS name,
      CAST(1 + o_custkey % 115 AS STRING) AS sector, CAST(1 + o_orderkey % 3 AS STRING) AS rooms,
      CAST(500 + o_custkey % 1500 AS STRING) AS area, 1 + o_custkey % 9 AS whole, 11 + o_custkey % 89 AS part,
      CAST(9000000000 + o_custkey AS STRING) AS mobile
    FROM orders
"""

SALE_TEXT = (
    "title || ' Sector ' || sector || chr(10) || rooms || ' BHK' || chr(10) || 'Size ' || area || ' sqft' || chr(10) || "
    "'Asking ' || CAST(whole AS STRING) || '.' || CAST(part AS STRING) || ' cr' || chr(10) || 'call ' || name || ' ' || mobile"
)

# the second ad of a message with two: the next society, one room more, a rent
RENT_TEXT = (
    "'Orchid Residency, Sector ' || sector || chr(10) || rooms || ' BHK for rent' || chr(10) || "
    "'Rent ' || CAST(15 + ck % 80 AS STRING) || ' k per month' || chr(10) || name || chr(10) || mobile"
)

MS = {"spark": "unix_millis(CAST(o_orderdate AS TIMESTAMP))", "duckdb": "epoch_ms(o_orderdate)"}


def ads_sql(dialect: str, text: str = SALE_TEXT) -> str:
    return f"SELECT *, {text} AS text FROM ({AD_FIELDS_SQL.format(ms=MS[dialect])})"


def ads_with(text: str = SALE_TEXT) -> str:
    """``WITH ads AS (...)`` for an expected result."""
    return f"WITH ads AS ({ads_sql('duckdb', text)})"


# What the rules make of a sale ad, by arithmetic on the columns it was made from
PRICE = "CAST(whole AS VARCHAR) || '.' || rtrim(CAST(part AS VARCHAR), '0')"
SOCIETY = "CASE WHEN project = '' THEN title || ' Sector ' || sector ELSE project END"
STATUS = "CASE WHEN project = '' THEN 'OUT' ELSE 'IN' END"
KEY = (
    "sha256(lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) || '|' || "
    "lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')))"
)

# One row per distinct ad, the earliest post of each, as an inventory
KEPT_WITH = f"""
{ads_with()},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ck, rooms ORDER BY timestamp_ms, chat_id, message_id) AS nth FROM ads
),
kept AS (
  SELECT {KEY} AS dedup_key, timestamp_ms AS ts, chat_id, message_id, 0 AS part_no, {SOCIETY} AS society,
    {STATUS} AS status, sector AS sec, area, rooms || 'BHK' AS acco, '' AS floor, '' AS flat_no, {PRICE} || ' CR' AS price,
    text AS full_message, name AS dealer, mobile AS phone
  FROM ranked WHERE nth = 1
),
flagged AS (
  SELECT *, row_number() OVER (
    PARTITION BY society, dealer ORDER BY ts DESC, chat_id DESC, message_id DESC) <> 1 AS is_duplicate
  FROM kept
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def chat_tables(spark: SparkSession, sf_dir: str) -> ChatTables:
    return as_chat_tables({n: run_sql(spark, sf_dir, "conversations", sql) for n, sql in CHAT_SQL.items()})


def ads(spark: SparkSession, sf_dir: str, text: str = SALE_TEXT) -> DataFrame:
    """Ads with the columns they were made from.

    The table of orders is a single row group, which one task reads; its rows
    are dealt out, since the rules cost far more than the reading.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey").createOrReplaceTempView("orders")
    return spark.sql(ads_sql("spark", text))


def messages(spark: SparkSession, sf_dir: str, text: str = SALE_TEXT) -> DataFrame:
    """Ads as group messages: ``(chat_id, message_id, timestamp_ms, sender, text)``."""
    return ads(spark, sf_dir, text).select("chat_id", "message_id", "timestamp_ms", "sender", "text")
