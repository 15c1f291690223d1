"""Every operator as a query over the driver tables, with its expected result as SQL."""

from .registry import ORACLES, QUERIES
from . import ads, browsing, coverage, documents, editing, inventory, listings  # noqa: F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES"]
