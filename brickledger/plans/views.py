"""Operators as temporary views, for users of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.unicode import SQL_FUNCTIONS
from ..operators.chats import chat_messages, list_chats
from ..operators.managed import all_values
from ..operators.summaries import curated_summaries, inventory_kpis, out_summaries, project_summaries, totals
from ..registry import Registry
from ..sources.chat_tables import ChatTables, recent_group_messages


def register_views(inventory: DataFrame, registry: Registry, prefix: str = "") -> list[str]:
    """Make the inventory and its summaries views of the session; returns their names."""
    summaries = project_summaries(inventory)
    views = {
        "inventory": inventory,
        "inventory_totals": totals(inventory),
        "project_summaries": summaries,
        "curated_summaries": curated_summaries(inventory, registry),
        "out_summaries": out_summaries(inventory, registry),
        "inventory_kpis": inventory_kpis(summaries),
        "projects": registry.names_df(inventory.sparkSession),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the Unicode functions callable from SQL: ``nfkc(text)``, ``plain_letters(text)`` and, on arrays, ``plain_letters_each``."""
    for name, function in SQL_FUNCTIONS.items():
        spark.udf.register(prefix + name, function)
    return [prefix + name for name in SQL_FUNCTIONS]


def _sql_string(text: str) -> str:
    return "'" + "".join(f"\\u{ord(ch):04x}" for ch in text) + "'"


# A search as users type it: trimmed, a backslash is itself, % and _ are wildcards
_STRIPPED = f"btrim(q, {_sql_string(P.WHITESPACE)})"
_PATTERN = f"'%' || replace({_STRIPPED}, '\\\\', '\\\\\\\\') || '%'"


def _create(spark: SparkSession, name: str, parameters: str, source: DataFrame, condition: str, hidden: str = "") -> None:
    """A temporary SQL function that returns the rows of ``source`` that its parameters ask for, without a ``hidden`` column."""
    view = f"{name}_rows"
    source.createOrReplaceTempView(view)
    shown = [f for f in source.schema.fields if f.name != hidden]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown)
    names = ", ".join(f"`{f.name}`" for f in shown)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN SELECT {names} FROM {view} WHERE {condition}")


def register_chat_functions(tables: ChatTables, prefix: str = "") -> list[str]:
    """Make chats callable from SQL, as functions that return tables; returns their names.

    ``list_chats(q, only_groups)``, ``chat_messages(chat)`` (all chats for a
    null), ``search_messages(q, chat)`` and ``recent_group_messages(since_ms)``
    give the rows of the Python functions without order or page: a query adds
    ``ORDER BY`` and ``LIMIT``.
    """
    spark = tables.message.sparkSession
    shown = chat_messages(tables)
    subject = tables.chat.select(F.col("_id").alias("id"), "subject")
    chats = list_chats(tables, limit=None).join(subject, "id")
    # a search by time looks at the time of the chat too
    recent = recent_group_messages(tables, -2**63).join(tables.chat.select(F.col("_id").alias("chat_id"), "sort_timestamp"), "chat_id")
    in_chat = "(chat IS NULL OR chat_id = chat)"
    functions = {
        "list_chats": ("q STRING DEFAULT NULL, only_groups BOOLEAN DEFAULT false", chats,
                       f"(coalesce({_STRIPPED}, '') = '' OR subject ILIKE {_PATTERN} OR raw_jid ILIKE {_PATTERN}) AND (is_group OR NOT only_groups)", "subject"),
        "chat_messages": ("chat BIGINT DEFAULT NULL", shown, in_chat),
        "search_messages": ("q STRING, chat BIGINT DEFAULT NULL", shown, f"text ILIKE {_PATTERN} AND {in_chat}"),
        "recent_group_messages": ("since_ms BIGINT", recent, "sort_timestamp >= since_ms AND timestamp_ms >= since_ms", "sort_timestamp"),
    }
    for name, definition in functions.items():
        _create(spark, prefix + name, *definition)
    return [prefix + name for name in functions]


def register_inventory_functions(inventory: DataFrame, prefix: str = "") -> list[str]:
    """Make a flagged inventory callable from SQL: ``in_listings(q, project)`` and ``rows_for_project(project)``."""
    spark = inventory.sparkSession
    searched = inventory.withColumn("searched_values", all_values())
    functions = {
        "in_listings": ("q STRING DEFAULT NULL, project STRING DEFAULT NULL", searched,
                        f"status = 'IN' AND (coalesce({_STRIPPED}, '') = '' OR searched_values ILIKE {_PATTERN}) "
                        f"AND (coalesce({_STRIPPED.replace('q,', 'project,')}, '') = '' OR society = {_STRIPPED.replace('q,', 'project,')})", "searched_values"),
        "rows_for_project": ("project STRING", inventory, "society = project"),
    }
    for name, definition in functions.items():
        _create(spark, prefix + name, *definition)
    return [prefix + name for name in functions]
