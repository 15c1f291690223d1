"""Transcripts of chats as text and JSON.

A chat is a folder ``chat_id=...``; its part files joined in name order are
the document.  Messages are range-partitioned by chat and time: no task holds
a whole chat, however long, and no row holds more than one message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.strings import first_filled, is_blank
from ..operators.chats import all_chat_messages, chat_title
from ..operators.storage import replacing, scratch, stored
from ..sources.chat_tables import ChatTables

_ORDER = ["chat_id", "_row", "timestamp_ms", "id"]


def _chats(tables: ChatTables, chat_id: int | None) -> DataFrame:
    chats = tables.chat if chat_id is None else tables.chat.filter(F.col("_id") == chat_id)
    identity = tables.jid.select(F.col("_id").alias("jid_row_id"), "raw_string", "server")
    raw = F.coalesce("raw_string", F.lit(""))
    is_group = F.coalesce(F.col("server") == P.GROUP_SERVER, F.lit(False))
    return chats.join(identity, "jid_row_id").select(
        F.col("_id").alias("chat_id"), raw.alias("raw_jid"), is_group.alias("is_group"),
        chat_title(F.col("subject"), raw, is_group).alias("title"),
    )


def _row(kind: int, value: Column, timestamp: Column | None = None, message: Column | None = None) -> list[Column]:
    null = F.lit(None).cast("long")
    return [
        F.col("chat_id"), F.lit(kind).alias("_row"), (null if timestamp is None else timestamp).alias("timestamp_ms"),
        (null if message is None else message).alias("id"), value.alias("value"),
    ]


def _write(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    with scratch(spark), replacing(spark, path) as staged:
        ordered = stored(rows, "lines").repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
        ordered.select("chat_id", "value").write.partitionBy("chat_id").text(staged)


def message_line() -> Column:
    """``[time] sender: content`` of a message row."""
    time = F.when(
        F.col("timestamp_ms") > 0, F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd HH:mm:ss")
    ).otherwise(P.UNKNOWN_TIME)
    sender = F.when(F.col("is_from_me"), "You").otherwise(F.col("sender.display_label"))
    text = F.when(~is_blank(F.col("text")), F.col("text"))
    content = first_filled(F.concat_ws(" ", F.col("metadata_summary"), text), F.lit(P.EMPTY_MESSAGE))
    return F.concat(F.lit("["), time, F.lit("] "), sender, F.lit(": "), content)


def text_lines(tables: ChatTables, exported_at_ms: int, chat_id: int | None = None) -> DataFrame:
    """Header and message lines with the columns that order them."""
    before, after = P.EXPORT_TITLE.split("{}")
    exported = F.date_format(F.timestamp_millis(F.lit(exported_at_ms)), "yyyy-MM-dd HH:mm:ss")
    header = F.concat(
        F.lit(before), F.col("title"), F.lit(after + "\nChat JID: "), F.col("raw_jid"), F.lit(" | Type: "),
        F.when(F.col("is_group"), "Group").otherwise("Direct Chat"),
        F.lit("\nExported: "), exported, F.lit("\n" + P.EXPORT_RULE + "\n"),
    )
    messages = all_chat_messages(tables, chat_id)
    return _chats(tables, chat_id).select(*_row(0, header)).unionByName(
        messages.select(*_row(1, message_line(), F.col("timestamp_ms"), F.col("id")))
    )


def export_text(tables: ChatTables, path: str, exported_at_ms: int, chat_id: int | None = None) -> None:
    """Write the transcript of one chat, or of every chat, as text."""
    _write(text_lines(tables, exported_at_ms, chat_id), path)


def message_json() -> Column:
    sender = F.col("sender")
    return F.to_json(F.struct(
        F.col("id"), F.col("message_key_id").alias("messageKeyId"), F.col("timestamp_ms").alias("timestampMs"),
        F.struct(
            sender["raw_jid"].alias("rawJid"), sender["phone_number"].alias("phoneNumber"),
            sender["push_name"].alias("pushName"), sender["resolved_display_name"].alias("resolvedDisplayName"),
        ).alias("sender"),
        F.col("is_from_me").alias("isFromMe"), F.col("text"), F.col("type_name").alias("messageType"),
        F.col("metadata_summary").alias("metadataSummary"),
    ), {"ignoreNullFields": "false"})


def json_lines(tables: ChatTables, exported_at_ms: int, chat_id: int | None = None) -> DataFrame:
    """Lines that make up ``{"exportMetadata": ..., "messages": [...]}`` for every chat."""
    message = tables.message if chat_id is None else tables.message.filter(F.col("chat_row_id") == chat_id)
    # which message opens a chat is joined back on the message id, a unique key
    opening = message.groupBy(F.col("chat_row_id").alias("chat_id")).agg(
        F.count("*").alias("n"), F.min_by("_id", F.struct("timestamp", "_id")).alias("id")
    )
    metadata = F.to_json(F.struct(
        F.lit(P.EXPORT_VERSION).alias("version"), F.lit(exported_at_ms).alias("exportTimestamp"),
        F.col("title").alias("chatName"), F.col("raw_jid").alias("chatJid"), F.col("is_group").alias("isGroup"),
        F.coalesce("n", F.lit(0)).alias("messageCount"),
    ), {"ignoreNullFields": "false"})
    chats = _chats(tables, chat_id)
    head = chats.join(opening.select("chat_id", "n"), "chat_id", "left").select(
        *_row(0, F.concat(F.lit('{\n  "exportMetadata": '), metadata, F.lit(',\n  "messages": [')))
    )
    messages = all_chat_messages(tables, chat_id).join(
        opening.select("id", F.lit(True).alias("_opens")), "id", "left"
    )
    separator = F.when(F.col("_opens"), "    ").otherwise("   ,")
    body = messages.select(*_row(1, F.concat(separator, message_json()), F.col("timestamp_ms"), F.col("id")))
    return head.unionByName(body).unionByName(chats.select(*_row(2, F.lit("  ]\n}"))))


def export_json(tables: ChatTables, path: str, exported_at_ms: int, chat_id: int | None = None) -> None:
    """Write the transcript of one chat, or of every chat, as a JSON document."""
    _write(json_lines(tables, exported_at_ms, chat_id), path)
