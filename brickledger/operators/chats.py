"""Browsing, searching and counting the chats of a message database."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.strings import is_blank
from ..sources.chat_tables import ChatTables, with_sender
from .ranking import numbered
from .search import like_pattern
from .text_index import TextIndex


MOST_TOP_K = 100_000  # rows that a page keeps in a task to skip all but its own


def user_part(raw_jid: Column) -> Column:
    return F.substring_index(raw_jid, "@", 1)


def chat_title(subject: Column, raw_jid: Column, is_group: Column) -> Column:
    """Subject, else "Group <user>", else the phone number or user."""
    user = user_part(raw_jid)
    return (
        F.when(~is_blank(subject), subject)
        .when(is_group, F.concat(F.lit("Group "), user))
        .when(user.rlike(r"^\p{Nd}*$"), F.concat(F.lit("+"), user))
        .otherwise(user)
    )


def phone_number(raw_jid: Column) -> Column:
    """``+user`` when the user part is a number of seven digits or more, else null."""
    user = user_part(raw_jid)
    return F.when(user.rlike(r"^\p{Nd}{7,}$"), F.concat(F.lit("+"), user))


def contact_label(resolved: Column, push_name: Column, phone: Column, raw_jid: Column) -> Column:
    """Resolved name, else "push name (phone)", push name, phone or raw id."""
    return F.coalesce(
        resolved,
        F.concat(push_name, F.lit(" ("), phone, F.lit(")")),
        push_name,
        phone,
        raw_jid,
    )


def type_name(message_type: Column) -> Column:
    names = reduce(lambda case, kind: case.when(message_type == kind[0], kind[1]), P.MESSAGE_TYPES, F)
    return names.otherwise(P.OTHER_TYPE_NAME)


def type_label(message_type: Column) -> Column:
    labels = reduce(lambda case, kind: case.when(message_type == kind[0], kind[2]), P.MESSAGE_TYPES, F)
    return labels.otherwise(P.OTHER_TYPE)


def page_of(rows: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Rows in ``order`` from ``offset`` on, at most ``limit`` of them; all that remain if it is ``None``.

    A page of stated size near the start is a top-k.  Farther on, or without a
    size, the rows are numbered by range, so that skipping some does not bring
    all the others into one task.
    """
    if limit is not None and offset + limit <= MOST_TOP_K:
        return rows.orderBy(*order).offset(offset).limit(limit)
    if not offset and limit is None:
        return rows.orderBy(*order)
    placed = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], order, "_place")
    end = F.lit(True) if limit is None else F.col("_place") <= offset + limit
    return placed.filter((F.col("_place") > offset) & end).drop("_all", "_place").orderBy(*order)


def sorted_page(page: DataFrame, *order: Column) -> DataFrame:
    """Rows that were cut from a sorted page and joined since, in order.

    The optimizer can take a page and joins that it re-plans at run time for a
    single row, and drops the sort of several (seen in Spark 4.1).  Behind a
    generator it knows no number of rows and keeps it.
    """
    return page.select("*", F.explode(F.array(F.lit(0))).alias("_once")).orderBy(*order).drop("_once")


def list_chats(
    tables: ChatTables, query: str | None = None, only_groups: bool = False, limit: int | None = 100,
    offset: int = 0
) -> DataFrame:
    """One page of chats, most recent first; all chats from ``offset`` on if ``limit`` is ``None``.

    ``query`` is looked for in subject and id; ``%`` and ``_`` in it are wildcards.
    """
    identity = tables.jid.select(F.col("_id").alias("jid_row_id"), "raw_string", "server")
    if only_groups:
        identity = identity.filter(F.col("server") == P.GROUP_SERVER)
    chats = tables.chat.join(identity, "jid_row_id")
    if query is not None and query.strip():
        pattern = like_pattern(query)
        chats = chats.filter(F.col("subject").ilike(pattern) | F.col("raw_string").ilike(pattern))
    raw_jid = F.coalesce("raw_string", F.lit(""))
    is_group = F.coalesce(F.col("server") == P.GROUP_SERVER, F.lit(False))
    page = page_of(chats, [F.col("sort_timestamp").desc(), F.col("_id")], limit, offset)
    return page.select(
        F.col("_id").alias("id"),
        raw_jid.alias("raw_jid"),
        chat_title(F.col("subject"), raw_jid, is_group).alias("title"),
        is_group.alias("is_group"),
        F.when(F.col("sort_timestamp") > 0, F.col("sort_timestamp")).alias("last_message_timestamp_ms"),
        (F.coalesce("archived", F.lit(0)) == 1).alias("is_archived"),
    )


def _with_identities(message: DataFrame, tables: ChatTables) -> DataFrame:
    """Messages with the raw ids of sender and chat.  Every join is on a unique id."""
    chat = tables.chat.select(F.col("_id").alias("chat_row_id"), "jid_row_id").join(
        tables.jid.select(F.col("_id").alias("jid_row_id"), F.col("raw_string").alias("chat_raw")), "jid_row_id", "left"
    ).drop("jid_row_id")
    return with_sender(message, tables, "_id").join(chat, "chat_row_id", "left")


def _message_columns() -> list[Column]:
    from_me = F.coalesce(F.col("from_me") == 1, F.lit(False))
    raw = F.when(from_me, "me").otherwise(F.coalesce(
        F.when(~is_blank(F.col("sender_raw")), F.col("sender_raw")),
        F.when(~is_blank(F.col("chat_raw")), F.col("chat_raw")),
        F.lit("unknown"),
    ))
    resolved = F.when(from_me, F.lit("You"))
    push_name = F.lit(None).cast("string")
    phone = F.when(~from_me, phone_number(raw))
    label = type_label(F.col("message_type"))
    sender = F.struct(
        raw.alias("raw_jid"), phone.alias("phone_number"), push_name.alias("push_name"),
        resolved.alias("resolved_display_name"), contact_label(resolved, push_name, phone, raw).alias("display_label"),
    )
    is_text = F.coalesce(F.col("message_type") == P.TEXT_TYPE, F.lit(False))
    return [
        F.col("chat_row_id").alias("chat_id"),
        F.col("_id").alias("id"),
        F.coalesce("key_id", F.col("_id").cast("string")).alias("message_key_id"),
        F.col("timestamp").alias("timestamp_ms"),
        sender.alias("sender"),
        from_me.alias("is_from_me"),
        F.col("text_data").alias("text"),
        label.alias("message_type"),
        type_name(F.col("message_type")).alias("type_name"),
        F.when(~is_text, F.concat(F.lit("["), label, F.lit("]"))).alias("metadata_summary"),
    ]


def chat_messages(
    tables: ChatTables, chat_id: int | None = None, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Messages in time order, of one chat or of all; all messages without a page come unordered.

    A page is cut from the message table before any identity is joined, so
    only its rows take part in the joins.
    """
    message, page_order = tables.message, ["timestamp", "_id"]
    if chat_id is not None:
        message = message.filter(F.col("chat_row_id") == chat_id)
    if offset or limit is not None:
        message = page_of(message, [F.col(c) for c in page_order], limit, offset)
    shown = _with_identities(message, tables).select(*_message_columns())
    if chat_id is None and limit is None and not offset:
        return shown
    return sorted_page(shown, F.col("timestamp_ms"), F.col("id"))


def all_chat_messages(tables: ChatTables, chat_id: int | None = None) -> DataFrame:
    """Every message of a chat in time order, or of all chats, unordered, by ``chat_id``."""
    return chat_messages(tables, chat_id)


def search_messages(
    tables: ChatTables, q: str, chat_id: int | None = None, limit: int | None = 50, index: TextIndex | None = None
) -> DataFrame:
    """The newest messages whose text holds ``q``, without regard to case; all of them if ``limit`` is ``None``.

    The newest rows are picked before identities are joined.  With an
    ``index`` of the messages only the blocks that may hold ``q`` are read.
    """
    found = index.search(q) if index else tables.message.filter(F.col("text_data").ilike(like_pattern(q)))
    if chat_id is not None:
        found = found.filter(F.col("chat_row_id") == chat_id)
    newest = found if limit is None else page_of(found, [F.col("timestamp").desc(), F.col("_id").desc()], limit)
    shown = _with_identities(newest, tables).select(*_message_columns())
    return sorted_page(shown, F.col("timestamp_ms").desc(), F.col("id").desc())


def count_messages(tables: ChatTables) -> DataFrame:
    """Number of messages of every chat that has any."""
    return tables.message.groupBy(F.col("chat_row_id").alias("chat_id")).agg(F.count("*").alias("message_count"))
