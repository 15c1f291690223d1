"""Property inventory from chat messages, as Spark jobs."""

from . import schemas
from .operators.chats import (
    all_chat_messages, chat_messages, count_messages, list_chats, search_messages,
)
from .operators.dedup import consolidate, flag_superseded, keep_earliest, text_key
from .operators.edits import (
    add_society, apply_edits, apply_society_status, delete_listing, demote_society, new_listing, promote_society,
    update_listing,
)
from .operators.levels import Levels, Snapshot, snapshot, vacuum
from .operators.storage import scratch
from .operators.managed import in_listings, index_inventory, rows_for_project
from .operators.managed_table import edit_managed, managed, read_managed, write_managed
from .operators.summaries import (
    curated_summaries, filter_out_projects, filter_projects, inventory_kpis, out_summaries, project_summaries, totals,
)
from .operators.text_index import TextIndex
from .operators.windows import latest_timestamp, recent_listings, window_cutoff
from .plans.extraction import display_form, extract_listings, parse_texts, to_inventory_rows
from .plans.inventory import batch_inventory, build_inventory, build_listings, compact_parse_cache, extract_once, run_counters
from .plans.views import register_chat_functions, register_functions, register_inventory_functions, register_views
from .registry import CustomProject, Registry, normalize_project_name
from .sinks.inventory_csv import write_inventory_csv
from .sinks.transcripts import export_json, export_text
from .sources.chat_tables import (
    ChatTables, SchemaReport, active_groups, as_chat_tables, check_schema, inspect_schema, inventory_messages,
    read_chat_tables, recent_group_messages,
)
from .sources.custom_projects import read_registry, write_registry
from .streaming.inventory_stream import compact, earliest_posts_stream, inventory_levels, read_inventory, stream_inventory

__all__ = [name for name in dir() if not name.startswith("_")]
