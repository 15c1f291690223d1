"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

CHAT_TABLES = {
    "jid": "_id long, raw_string string, user string, server string",
    "chat": "_id long, jid_row_id long, subject string, sort_timestamp long, archived int",
    "message": (
        "_id long, chat_row_id long, sender_jid_row_id long, from_me int, key_id string, timestamp long, "
        "message_type int, text_data string"
    ),
    "jid_map": "lid_row_id long, jid_row_id long",
}

RAW_MESSAGES = "chat_id long, message_id long, timestamp_ms long, sender string, text string"

# the twelve inventory fields, in file order
INVENTORY_FIELDS = [
    "society", "status", "sec", "area", "acco", "floor", "flat_no", "dealer", "phone", "price", "full_message",
]
POST_ORDER = ["chat_id", "message_id", "part_no"]
INVENTORY = (
    "dedup_key string, ts long, chat_id long, message_id long, part_no int, society string, status string, "
    "sec string, area string, acco string, floor string, flat_no string, dealer string, phone string, "
    "price string, full_message string, is_duplicate boolean"
)

CUSTOM_PROJECTS = "name string, aliases array<string>"
EDITS = (
    "id string, op string, edited_at timestamp, row struct<society: string, status: string, sec: string, "
    "area: string, acco: string, floor: string, flat_no: string, dealer: string, phone: string, price: string, "
    "full_message: string>"
)
SOCIETY_STATUS = "society string, status string, edited_at timestamp"
