"""Reading chat, message and identity tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..schemas import CHAT_TABLES

REQUIRED_TABLES = ["chat", "message", "jid"]
REQUIRED_MESSAGE_COLUMNS = ["text_data", "chat_row_id", "timestamp"]
# How Spark and the usual databases say that a table is not there.
MISSING_TABLE = [
    "path_not_found", "no such table", "doesn't exist", "does not exist", "table or view not found", "table_or_view_not_found",
    "invalid object name", "ora-00942",
]


@dataclass(frozen=True)
class ChatTables:
    """The tables of a message database; ``jid_map`` links opaque identities to phone identities."""

    chat: DataFrame
    message: DataFrame
    jid: DataFrame
    jid_map: DataFrame | None = None

    def senders(self) -> DataFrame:
        """``(_id, raw_string)`` of identities, with the phone identity where one is mapped.

        ``jid_map`` must hold each ``lid_row_id`` once.
        """
        jid = self.jid.select("_id", "raw_string")
        if self.jid_map is None:
            return jid
        phone = jid.select(F.col("_id").alias("jid_row_id"), F.col("raw_string").alias("_phone"))
        mapped = self.jid_map.join(phone, "jid_row_id", "left").select(F.col("lid_row_id").alias("_id"), "_phone")
        return jid.join(mapped, "_id", "left").select("_id", F.coalesce("_phone", "raw_string").alias("raw_string"))


@dataclass(frozen=True)
class SchemaReport:
    is_supported: bool
    tables_found: tuple[str, ...]
    message_columns_found: tuple[str, ...]
    summary: str


def inspect_schema(tables: dict[str, DataFrame]) -> SchemaReport:
    """Compare table and column names, without regard to case, with what is required."""
    names = {name.lower(): df for name, df in tables.items()}
    message = names.get("message", names.get("messages"))
    columns = tuple(c.lower() for c in message.columns) if message is not None else ()
    supported = all(t in names for t in REQUIRED_TABLES) and all(c in columns for c in REQUIRED_MESSAGE_COLUMNS)
    summary = "\n".join([
        f"Tables: {len(names)} found ({', '.join(sorted(names))})",
        f"Message columns: {', '.join(columns)}",
        "Status: supported" if supported else "Status: unrecognised schema",
    ])
    return SchemaReport(supported, tuple(sorted(names)), columns, summary)


def check_schema(tables: dict[str, DataFrame]) -> SchemaReport:
    """``inspect_schema``, raising ``ValueError`` for an unsupported schema."""
    report = inspect_schema(tables)
    if not report.is_supported:
        raise ValueError(f"unsupported chat tables\n{report.summary}")
    return report


def as_chat_tables(tables: dict[str, DataFrame]) -> ChatTables:
    check_schema(tables)
    names = {name.lower(): df for name, df in tables.items()}
    return ChatTables(names["chat"], names["message"], names["jid"], names.get("jid_map"))


def _is_missing(error: Exception) -> bool:
    text = str(error).lower()
    return any(mark in text for mark in MISSING_TABLE)


def read_chat_tables(
    spark: SparkSession, path: str, fmt: str = "parquet", table_options: dict[str, dict[str, str]] | None = None, **options: str
) -> ChatTables:
    """Read the tables below ``path``, or by name from a JDBC URL when ``fmt`` is ``"jdbc"``.

    JDBC needs the driver jar on the class path.  ``options`` go to the reader
    of every table, ``table_options`` to that of one: ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` for ``message`` let
    many tasks read it.  ``jid_map`` is optional; only its absence is taken for
    one, any other error is raised.
    """
    def load(name: str) -> DataFrame:
        reader = spark.read.format(fmt).options(**options, **(table_options or {}).get(name, {}))
        if fmt == "jdbc":
            return reader.option("url", path).option("dbtable", name).load()
        if fmt in ("csv", "json"):
            reader = reader.schema(CHAT_TABLES[name])
        return reader.load(f"{path}/{name}.{fmt}")

    tables = {name: load(name) for name in REQUIRED_TABLES}
    try:
        tables["jid_map"] = load("jid_map")
        tables["jid_map"].schema
    except Exception as error:
        if not _is_missing(error):
            raise
        tables.pop("jid_map", None)
    return as_chat_tables(tables)


def with_sender(message: DataFrame, tables: ChatTables, message_id: str) -> DataFrame:
    """Add ``sender_raw``, the raw id of the sender, to messages with ``sender_jid_row_id``.

    Own messages have no sender.  They get a key of their own from the message
    id, so that all of them do not meet in one task; the second condition
    keeps such a key from finding anyone.
    """
    sender = tables.senders().select(F.col("_id").alias("_sender"), F.col("raw_string").alias("sender_raw"))
    spread = F.coalesce("sender_jid_row_id", -1 - F.pmod(F.xxhash64(message_id), F.lit(1 << 40)))
    keyed = message.withColumn("_key", spread)
    found = (F.col("_key") == F.col("_sender")) & F.col("sender_jid_row_id").isNotNull()
    return keyed.join(sender, found, "left").drop("_key", "_sender")


def _active_groups(tables: ChatTables, since_ms: int) -> DataFrame:
    """``(chat_id, chat_raw)`` of group chats with anything new since ``since_ms``."""
    groups = tables.jid.filter(F.col("server") == P.GROUP_SERVER).select(
        F.col("_id").alias("jid_row_id"), F.col("raw_string").alias("chat_raw")
    )
    chats = tables.chat.filter(F.col("sort_timestamp") >= since_ms).select(F.col("_id").alias("chat_id"), "jid_row_id")
    return chats.join(groups, "jid_row_id").drop("jid_row_id")


def active_groups(tables: ChatTables, since_ms: int) -> DataFrame:
    """``(chat_id, name)`` of the group chats an inventory scan goes through."""
    named = _active_groups(tables, since_ms).join(
        tables.chat.select(F.col("_id").alias("chat_id"), "subject"), "chat_id"
    )
    return named.select("chat_id", F.coalesce("subject", "chat_raw", F.lit("Group")).alias("name"))


def recent_group_messages(tables: ChatTables, since_ms: int, sender_fallback: str = "chat") -> DataFrame:
    """Text messages of active group chats: ``(chat_id, message_id, timestamp_ms, sender, text)``.

    The sender is the mapped phone identity, else the sender's own, else with
    ``sender_fallback="chat"`` that of the chat, else ``Unknown``.
    """
    if sender_fallback not in ("chat", "unknown"):
        raise ValueError("sender_fallback is 'chat' or 'unknown'")
    message = tables.message.filter(
        (F.col("timestamp") >= since_ms)
        & (F.col("message_type") == P.TEXT_TYPE)
        & F.col("text_data").isNotNull()
        & (F.col("text_data") != "")
    ).select(
        F.col("chat_row_id").alias("chat_id"), F.col("_id").alias("message_id"),
        F.col("timestamp").alias("timestamp_ms"), "sender_jid_row_id", F.col("text_data").alias("text"),
    )
    known = [F.col("sender_raw")] + ([F.col("chat_raw")] if sender_fallback == "chat" else [])
    return (
        with_sender(message.join(_active_groups(tables, since_ms), "chat_id"), tables, "message_id")
        .select("chat_id", "message_id", "timestamp_ms", F.coalesce(*known, F.lit("Unknown")).alias("sender"), "text")
    )


def inventory_messages(tables: ChatTables, since_ms: int) -> DataFrame:
    """Messages of the two-step inventory scan: active groups first, sender or ``Unknown``."""
    return recent_group_messages(tables, since_ms, sender_fallback="unknown")
