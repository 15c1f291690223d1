"""Chats: sources, listing, reading, searching, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

import brickledger as b
from brickledger.functions.dealer import clean_sender, is_lid, phone_of
from brickledger.operators.chats import contact_label, phone_number
from brickledger.operators.storage import new_path
from brickledger.sinks.transcripts import json_lines, text_lines

from .inputs import CHAT_WITH, chat_tables, table
from .registry import check

SINCE = 150_000
EXPORTED_AT = 1_700_000_000_000

TITLE = """CASE WHEN trim(c.subject) <> '' THEN c.subject WHEN j.server = 'g.us' THEN 'Group ' || split_part(j.raw_string, '@', 1)
  WHEN regexp_full_match(split_part(j.raw_string, '@', 1), '[0-9]*') THEN '+' || split_part(j.raw_string, '@', 1)
  ELSE split_part(j.raw_string, '@', 1) END"""
CHATS = f"""SELECT c._id AS id, j.raw_string AS raw_jid, {TITLE} AS title, j.server = 'g.us' AS is_group,
  CASE WHEN c.sort_timestamp > 0 THEN c.sort_timestamp END AS last_message_timestamp_ms,
  coalesce(c.archived, 0) = 1 AS is_archived
FROM chat c JOIN jid j ON c.jid_row_id = j._id"""
LABEL = """CASE m.message_type WHEN 0 THEN 'Text' WHEN 1 THEN 'Photo' WHEN 64 THEN 'Poll' ELSE 'Attachment' END"""
TYPE_NAME = """CASE m.message_type WHEN 0 THEN 'TEXT' WHEN 1 THEN 'IMAGE' WHEN 64 THEN 'POLL' ELSE 'UNKNOWN' END"""
SENT = """FROM message m
LEFT JOIN jid s ON m.sender_jid_row_id = s._id
LEFT JOIN jid_map jm ON s._id = jm.lid_row_id LEFT JOIN jid p ON jm.jid_row_id = p._id
LEFT JOIN chat c ON m.chat_row_id = c._id LEFT JOIN jid j ON c.jid_row_id = j._id"""
READ = f"""read_messages AS (
SELECT *, CASE WHEN is_from_me THEN 'You' WHEN regexp_full_match(split_part(raw, '@', 1), '[0-9]{{7,}}')
    THEN '+' || split_part(raw, '@', 1) ELSE raw END AS sender_label,
  CASE WHEN NOT is_from_me AND regexp_full_match(split_part(raw, '@', 1), '[0-9]{{7,}}')
    THEN '+' || split_part(raw, '@', 1) END AS sender_phone
FROM (
SELECT m.chat_row_id AS chat_id, m._id AS id, coalesce(m.key_id, CAST(m._id AS VARCHAR)) AS message_key_id,
  m.timestamp AS timestamp_ms, m.from_me = 1 AS is_from_me, m.text_data AS text, {LABEL} AS message_type,
  {TYPE_NAME} AS type_name,
  CASE WHEN m.message_type = 0 THEN NULL ELSE '[' || {LABEL} || ']' END AS metadata_summary,
  CASE WHEN m.from_me = 1 THEN 'me' ELSE coalesce(p.raw_string, s.raw_string, j.raw_string, 'unknown') END AS raw
{SENT}))"""
COLUMNS = "chat_id, id, message_key_id, timestamp_ms, is_from_me, text, message_type, metadata_summary, raw AS sender_raw, sender_label"


def shown(messages):
    return messages.select(
        "chat_id", "id", "message_key_id", "timestamp_ms", "is_from_me", "text", "message_type", "metadata_summary",
        F.col("sender.raw_jid").alias("sender_raw"), F.col("sender.display_label").alias("sender_label"),
    )


# Identities by arithmetic on a conversation, without a join: what the tables above say of each row
PHONE = "CAST(15551000000 + conv_id % 40 AS VARCHAR) || '@s.whatsapp.net'"
OPAQUE = f"CASE WHEN conv_id % 40 < 20 THEN {PHONE} ELSE CAST(70000000000000 + conv_id % 40 AS VARCHAR) || '@lid' END"
CHAT_RAW = """CASE WHEN conv_id % 2 = 0 THEN CAST(120363000000 + conv_id AS VARCHAR) || '@g.us'
  WHEN conv_id % 5 = 0 THEN 'user' || CAST(conv_id AS VARCHAR) || '@s.whatsapp.net'
  ELSE CAST(15550000000 + conv_id AS VARCHAR) || '@s.whatsapp.net' END"""
KIND = "CASE turn % 7 WHEN 4 THEN 1 WHEN 5 THEN 64 WHEN 6 THEN NULL ELSE 0 END"


def sent_by(otherwise: str) -> str:
    return f"CASE role WHEN 'user' THEN {PHONE} WHEN 'assistant' THEN {OPAQUE} ELSE {otherwise} END"


def recent(otherwise: str) -> str:
    # a chat with a message since then is active since then
    return f"""
    SELECT conv_id AS chat_id, conv_id * 1000 + turn AS message_id, turn * 60000 + conv_id * 1000 AS timestamp_ms,
      {sent_by(otherwise)} AS sender, text
    FROM conversations WHERE conv_id % 2 = 0 AND turn * 60000 + conv_id * 1000 >= {SINCE} AND turn % 7 < 4 AND text <> ''"""


@check("s1_chat_tables", f"""{CHAT_WITH}
    SELECT 'chat' AS name, _id AS id, coalesce(subject, '-') || '|' || sort_timestamp || '|' || coalesce(CAST(archived AS VARCHAR), '-') AS fields FROM chat
    UNION ALL SELECT 'message', _id, coalesce(text_data, '-') || '|' || timestamp || '|' || coalesce(CAST(sender_jid_row_id AS VARCHAR), '-') FROM message
    UNION ALL SELECT 'jid', _id, raw_string || '|' || server FROM jid
    UNION ALL SELECT 'jid_map', lid_row_id, CAST(jid_row_id AS VARCHAR) FROM jid_map""")
def s1(spark, sf):
    path = new_path(spark, "chats")
    for name, df in vars(chat_tables(spark, sf)).items():
        df.write.parquet(f"{path}/{name}.parquet")
    t = b.read_chat_tables(spark, path)

    def fields(df, name, key, *columns):
        return df.select(F.lit(name).alias("name"), F.col(key).alias("id"),
                         F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("fields"))
    return fields(t.chat, "chat", "_id", "subject", "sort_timestamp", "archived").union(
        fields(t.message, "message", "_id", "text_data", "timestamp", "sender_jid_row_id")).union(
        fields(t.jid, "jid", "_id", "raw_string", "server")).union(fields(t.jid_map, "jid_map", "lid_row_id", "jid_row_id"))


@check("s3_recent_group_messages", recent(CHAT_RAW))
def s3(spark, sf):
    return b.recent_group_messages(chat_tables(spark, sf), SINCE)


@check("s4_inventory_messages", recent("'Unknown'"))
def s4(spark, sf):
    return b.inventory_messages(chat_tables(spark, sf), SINCE)


@check("s4_active_groups", f"""{CHAT_WITH}
    SELECT c._id AS chat_id, coalesce(c.subject, j.raw_string, 'Group') AS name
    FROM chat c JOIN jid j ON c.jid_row_id = j._id WHERE j.server = 'g.us' AND c.sort_timestamp >= {SINCE}""")
def s4_groups(spark, sf):
    return b.active_groups(chat_tables(spark, sf), SINCE)


@check("c1_list_chats", f"{CHAT_WITH} {CHATS} ORDER BY c.sort_timestamp DESC, c._id LIMIT 60 OFFSET 10")
def c1(spark, sf):
    return b.list_chats(chat_tables(spark, sf), limit=60, offset=10)


@check("c1_list_groups_matching", f"""{CHAT_WITH} {CHATS}
    WHERE j.server = 'g.us' AND (c.subject ILIKE '%CHAT NO 1%' OR j.raw_string ILIKE '%CHAT NO 1%')
    ORDER BY c.sort_timestamp DESC, c._id LIMIT 100""")
def c1_groups(spark, sf):
    return b.list_chats(chat_tables(spark, sf), " CHAT NO 1 ", only_groups=True)


@check("c3_chat_messages_page", f"""{CHAT_WITH}, {READ}
    SELECT {COLUMNS} FROM read_messages ORDER BY timestamp_ms, id LIMIT 200 OFFSET 50""")
def c3(spark, sf):
    return shown(b.chat_messages(chat_tables(spark, sf), limit=200, offset=50))


@check("c4_all_chat_messages", f"""
    SELECT *, CASE WHEN is_from_me THEN 'You' WHEN sender_raw LIKE 'user%' THEN sender_raw ELSE '+' || split_part(sender_raw, '@', 1) END
        AS sender_label
    FROM (SELECT conv_id AS chat_id, conv_id * 1000 + turn AS id,
        CASE WHEN turn % 5 = 0 THEN CAST(conv_id * 1000 + turn AS VARCHAR) ELSE 'K' || CAST(conv_id * 1000 + turn AS VARCHAR) END AS message_key_id,
        turn * 60000 + conv_id * 1000 AS timestamp_ms, turn % 4 = 3 AS is_from_me, CASE WHEN turn % 7 <> 5 THEN text END AS text,
        CASE {KIND} WHEN 0 THEN 'Text' WHEN 1 THEN 'Photo' WHEN 64 THEN 'Poll' ELSE 'Attachment' END AS message_type,
        CASE {KIND} WHEN 0 THEN NULL WHEN 1 THEN '[Photo]' WHEN 64 THEN '[Poll]' ELSE '[Attachment]' END AS metadata_summary,
        CASE WHEN turn % 4 = 3 THEN 'me' ELSE {sent_by(CHAT_RAW)} END AS sender_raw FROM conversations)""")
def c4(spark, sf):
    return shown(b.all_chat_messages(chat_tables(spark, sf)))


@check("c5_search_messages", f"""{CHAT_WITH}, {READ}
    SELECT {COLUMNS} FROM read_messages WHERE text ILIKE '%TH%E%' ORDER BY timestamp_ms DESC, id DESC LIMIT 50""")
def c5(spark, sf):
    return shown(b.search_messages(chat_tables(spark, sf), " TH%E "))


@check("c5_indexed_search", f"""{CHAT_WITH}, {READ}
    SELECT {COLUMNS} FROM read_messages WHERE text ILIKE '%er th_ %re%' ORDER BY timestamp_ms DESC, id DESC LIMIT 500""")
def c5_indexed(spark, sf):
    tables = chat_tables(spark, sf)
    index = b.TextIndex(spark, new_path(spark, "index"))
    for batch in range(2):  # two batches of messages
        index.add(tables.message.filter(F.col("chat_row_id") % 2 == batch), batch, order="timestamp")
    return shown(b.search_messages(tables, " er Th_ %re", limit=500, index=index))


@check("c6_count_messages", "SELECT conv_id AS chat_id, count(*) AS message_count FROM conversations GROUP BY 1")
def c6(spark, sf):
    return b.count_messages(chat_tables(spark, sf))


@check("c7_message_types", f"""{CHAT_WITH}
    SELECT {TYPE_NAME} AS type_name, {LABEL} AS message_type, count(*) AS n FROM message m GROUP BY 1, 2""")
def c7(spark, sf):
    return b.all_chat_messages(chat_tables(spark, sf)).groupBy("type_name", "message_type").agg(F.count("*").alias("n"))


@check("c8_contact_label", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name
      WHEN c_custkey % 3 = 0 AND c_custkey >= 1000 THEN c_mktsegment || ' (+1000' || c_custkey || ')'
      WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN c_mktsegment || ' (+1000' || lpad(c_custkey::VARCHAR, 4, '0') || ')'
      WHEN c_custkey % 3 = 0 THEN c_mktsegment
      WHEN c_custkey >= 1000 THEN '+1000' || c_custkey
      WHEN c_custkey % 2 = 0 THEN '+1000' || lpad(c_custkey::VARCHAR, 4, '0')
      ELSE '99' || c_custkey || '@s.whatsapp.net' END AS label
    FROM customer""")
def c8(spark, sf):
    key = F.col("c_custkey").cast("string")
    jid = F.concat(
        F.when(F.col("c_custkey") >= 1000, F.concat(F.lit("1000"), key))
        .when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("1000"), F.lpad(key, 4, "0")))
        .otherwise(F.concat(F.lit("99"), key)),
        F.lit("@s.whatsapp.net"),
    )
    resolved = F.when(F.col("c_custkey") % 5 == 0, F.col("c_name"))
    push = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", contact_label(resolved, push, phone_number(jid), jid).alias("label"))


@check("c9_latest_timestamp", f"{CHAT_WITH} SELECT arg_max(timestamp, _id) AS latest_timestamp_ms FROM message")
def c9(spark, sf):
    return b.latest_timestamp(chat_tables(spark, sf).message)


@check("j4_mapped_senders", f"""
    SELECT DISTINCT conv_id AS _id, {CHAT_RAW} AS raw_string FROM conversations
    UNION ALL SELECT DISTINCT 1000000000 + conv_id % 40, {PHONE} FROM conversations
    UNION ALL SELECT DISTINCT 2000000000 + conv_id % 40, {OPAQUE} FROM conversations""")
def j4(spark, sf):
    return chat_tables(spark, sf).senders()


@check("i6_sender_identities", """
    SELECT c_custkey, c_custkey % 4 IN (0, 1) AS lid,
      CASE c_custkey % 4 WHEN 0 THEN '7000000000000' || c_custkey WHEN 1 THEN '9000000000000' || c_custkey
        WHEN 2 THEN CAST(919000000000 + c_custkey AS VARCHAR) ELSE c_name END AS sender,
      CASE c_custkey % 4 WHEN 0 THEN right('7000000000000' || c_custkey, 10) WHEN 1 THEN right('9000000000000' || c_custkey, 10)
        WHEN 2 THEN CAST(9000000000 + c_custkey AS VARCHAR) ELSE '' END AS phone
    FROM customer""")
def i6(spark, sf):
    key = F.col("c_custkey").cast("string")
    raw = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("7000000000000"), key, F.lit("@LID")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" 9000000000000"), key))
        .when(F.col("c_custkey") % 4 == 2, F.concat((919000000000 + F.col("c_custkey")).cast("string"), F.lit("@s.whatsapp.net")))
        .otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    )
    return table(spark, sf, "customer").select(
        "c_custkey", is_lid(raw).alias("lid"), clean_sender(raw).alias("sender"), phone_of(clean_sender(raw)).alias("phone"),
    )


@check("k6_transcript_text", f"""{CHAT_WITH}, {READ}
    SELECT chat_id, 1 AS kind, id, '[' || CASE WHEN timestamp_ms > 0
        THEN strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d %H:%M:%S') ELSE 'Unknown Time' END || '] ' || sender_label
      || ': ' || coalesce(metadata_summary || ' ' || text, text, metadata_summary, '[Empty / System Message]') AS value
    FROM read_messages
    UNION ALL
    SELECT id, 0, NULL, '=== WhatsApp Chat Export: ' || title || ' ===' || chr(10) || 'Chat JID: ' || raw_jid || ' | Type: '
      || CASE WHEN is_group THEN 'Group' ELSE 'Direct Chat' END || chr(10) || 'Exported: 2023-11-14 22:13:20' || chr(10)
      || repeat('-', 80) || chr(10)
    FROM ({CHATS})""")
def k6(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return text_lines(chat_tables(spark, sf), EXPORTED_AT).select("chat_id", F.col("_row").alias("kind"), "id", "value")


@check("k7_transcript_json", f"""{CHAT_WITH}, {READ}
    SELECT chat_id, 1 AS kind, id, message_key_id AS name, sender_phone AS detail, type_name AS type,
      row_number() OVER (PARTITION BY chat_id ORDER BY timestamp_ms, id) = 1 AS opens, NULL AS message_count,
      text, timestamp_ms AS time, raw AS sender FROM read_messages
    UNION ALL
    SELECT id, 0, NULL, title, raw_jid, '1.0', false, n, NULL, {EXPORTED_AT}, NULL
    FROM ({CHATS}) x JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = x.id
    UNION ALL
    SELECT id, 2, NULL, NULL, NULL, NULL, false, NULL, NULL, NULL, NULL FROM ({CHATS})""")
def k7(spark, sf):
    value = F.col("value")
    head = F.regexp_extract(value, r'"exportMetadata": (.*),\n', 1)
    body = F.substring(value, 5, 2**31 - 1)

    def of(kind, source, path):
        return F.when(F.col("_row") == kind, F.get_json_object(source, path))

    return json_lines(chat_tables(spark, sf), EXPORTED_AT).select(
        "chat_id", F.col("_row").alias("kind"), "id",
        F.coalesce(of(0, head, "$.chatName"), of(1, body, "$.messageKeyId")).alias("name"),
        F.coalesce(of(0, head, "$.chatJid"), of(1, body, "$.sender.phoneNumber")).alias("detail"),
        F.coalesce(of(0, head, "$.version"), of(1, body, "$.messageType")).alias("type"),
        ((F.col("_row") == 1) & value.startswith("    {")).alias("opens"),
        of(0, head, "$.messageCount").cast("long").alias("message_count"), of(1, body, "$.text").alias("text"),
        F.coalesce(of(0, head, "$.exportTimestamp"), of(1, body, "$.timestampMs")).cast("long").alias("time"),
        of(1, body, "$.sender.rawJid").alias("sender"),
    )


@check("sql_chat_messages", f"{CHAT_WITH}, {READ} SELECT {COLUMNS} FROM read_messages WHERE chat_id = 6")
def sql_messages(spark, sf):
    b.register_chat_functions(chat_tables(spark, sf), "check_")
    return shown(spark.sql("SELECT * FROM check_chat_messages(6)"))


@check("sql_search_messages", f"""{CHAT_WITH}, {READ}
    SELECT {COLUMNS} FROM read_messages WHERE text ILIKE '%TH%E%' ORDER BY timestamp_ms DESC, id DESC LIMIT 50""")
def sql_search(spark, sf):
    b.register_chat_functions(chat_tables(spark, sf), "check_")
    return shown(spark.sql("SELECT * FROM check_search_messages(' TH%E ') ORDER BY timestamp_ms DESC, id DESC LIMIT 50"))


@check("sql_list_chats", f"""{CHAT_WITH} {CHATS}
    WHERE j.server = 'g.us' AND (c.subject ILIKE '%CHAT NO 1%' OR j.raw_string ILIKE '%CHAT NO 1%')""")
def sql_chats(spark, sf):
    b.register_chat_functions(chat_tables(spark, sf), "check_")
    return spark.sql("SELECT * FROM check_list_chats(q => ' CHAT NO 1 ', only_groups => true)")


@check("sql_recent_group_messages", recent(CHAT_RAW))
def sql_recent(spark, sf):
    b.register_chat_functions(chat_tables(spark, sf), "check_")
    return spark.sql(f"SELECT * FROM check_recent_group_messages({SINCE})")
