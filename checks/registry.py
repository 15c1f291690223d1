"""The table of queries and of the SQL that states their results."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can state it, its expected result."""
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = textwrap.dedent(oracle).strip()
        return query
    return register
