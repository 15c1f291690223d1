"""Reading the managed inventory: listings of IN projects and of one project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INVENTORY_FIELDS, POST_ORDER
from .search import like_pattern
from .text_index import TextIndex


def all_values() -> Column:
    """What a search in the inventory looks through: the values of a listing, a line each."""
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in INVENTORY_FIELDS])


def index_inventory(inventory: DataFrame, path: str) -> TextIndex:
    """An index of the values of a flagged inventory, for ``in_listings``."""
    index = TextIndex(inventory.sparkSession, path, "_values")
    index.add(inventory.withColumn("_values", all_values()), 0, order="ts")
    return index


def in_listings(
    inventory: DataFrame | None, search: str | None = None, society: str | None = None, index: TextIndex | None = None
) -> DataFrame:
    """Flagged listings of IN projects, newest first.

    ``search`` is looked for in all values of a listing; ``%`` and ``_`` in it
    are wildcards.  ``inventory`` carries ``is_duplicate``: superseded ads are
    judged against the whole inventory, not against the listings found.  With
    an ``index`` made by ``index_inventory`` a search reads it instead.
    """
    if index is not None and search is not None and search.strip():
        rows, search = index.search(search).drop("_values").filter("status = 'IN'"), None
    else:
        rows = inventory.filter("status = 'IN'")
    if society is not None and society.strip():
        rows = rows.filter(F.col("society") == society.strip())
    if search is not None and search.strip():
        rows = rows.filter(all_values().ilike(like_pattern(search)))
    return rows.orderBy(F.col("ts").desc(), *[F.col(c).desc() for c in POST_ORDER])


def rows_for_project(inventory: DataFrame, society: str) -> DataFrame:
    """Flagged rows of one society in post order."""
    return inventory.filter(F.col("society") == society).orderBy("ts", *POST_ORDER)
