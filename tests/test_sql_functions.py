"""Operators called from SQL give what they give in Python."""

import pytest
from pyspark.sql import functions as F

import brickledger as b
from brickledger.schemas import CHAT_TABLES
from test_inventory import REGISTRY, SCHEMA, random_posts


@pytest.fixture(scope="module")
def tables(spark):
    def df(name, rows):
        return spark.createDataFrame(rows, CHAT_TABLES[name])

    texts = ["back\\slash", "100% sure", "under_score", "Ünder", None, "", " tab\tbed ", "plain", "PLAIN sailing", "a'quote"]
    message = [(i, 1 + i % 3, 20 if i % 4 else None, i % 2, f"k{i}", 1000 + 10 * i, 0 if i % 5 else 1, texts[i % 10]) for i in range(60)]
    return b.as_chat_tables({
        "chat": df("chat", [(1, 10, "Flats\\Lake", 5000, 0), (2, 11, None, 1200, 1), (3, 12, "Direct 100%", 0, None)]),
        "message": df("message", message),
        "jid": df("jid", [(10, "1203@g.us", "1203", "g.us"), (11, "1204@g.us", "1204", "g.us"), (12, "15550000001@s.whatsapp.net", "1", "s.whatsapp.net"),
                          (20, "15550000002@s.whatsapp.net", "2", "s.whatsapp.net")]),
    })


def rows(df):
    return sorted(map(repr, df.collect()))


QUERIES = ["back\\slash", "\\", "100%", "r_s", "  plain\t\n", "ü", "%", "a'q", "nothing like it", "tab\t"]


def test_chats_from_sql(spark, tables):
    b.register_chat_functions(tables, "t_")
    for q in QUERIES:
        found = spark.sql("SELECT * FROM t_search_messages(:q)", {"q": q})
        wanted = b.search_messages(tables, q, limit=None)
        assert found.columns == wanted.columns and rows(found) == rows(wanted)
        assert rows(spark.sql("SELECT * FROM t_search_messages(:q, 2)", {"q": q})) == rows(b.search_messages(tables, q, 2, None))
        for only in (True, False):
            asked = spark.sql("SELECT * FROM t_list_chats(:q, :only)", {"q": q, "only": only})
            assert rows(asked) == rows(b.list_chats(tables, q, only, None))
    assert rows(spark.sql("SELECT * FROM t_list_chats()")) == rows(b.list_chats(tables, limit=None))
    assert rows(spark.sql("SELECT * FROM t_chat_messages(3)")) == rows(b.chat_messages(tables, 3))
    assert rows(spark.sql("SELECT * FROM t_chat_messages()")) == rows(b.chat_messages(tables))
    for since in (0, 1100, 1300, 4000):
        assert rows(spark.sql(f"SELECT * FROM t_recent_group_messages({since})")) == rows(b.recent_group_messages(tables, since))
    page = spark.sql("SELECT id FROM t_chat_messages(1) ORDER BY timestamp_ms, id LIMIT 5 OFFSET 3").collect()
    assert [r.id for r in page] == [r.id for r in b.chat_messages(tables, 1, 5, 3).collect()]


def test_inventory_from_sql(spark):
    inventory = b.operators.storage.stored(b.build_inventory(spark.createDataFrame(random_posts(21, 60), SCHEMA), REGISTRY))
    b.register_inventory_functions(inventory, "t_")
    for q, project in ((None, None), ("3 bhk", None), (" 1_50 ", "SOBHA CITY"), ("", " GODREJ ICON\t"), ("%", "none")):
        found = spark.sql("SELECT * FROM t_in_listings(:q, :p)", {"q": q, "p": project})
        wanted = b.in_listings(inventory, q, project)
        assert found.columns == wanted.columns and rows(found) == rows(wanted)
    society = inventory.filter(F.col("status") == "OUT").first().society
    assert rows(spark.sql("SELECT * FROM t_rows_for_project(:s)", {"s": society})) == rows(b.rows_for_project(inventory, society))
