"""Substring search as users type it."""

from __future__ import annotations


def like_pattern(query: str) -> str:
    """LIKE pattern for a trimmed query; ``%`` and ``_`` stay wildcards, a backslash is itself."""
    return "%" + query.strip().replace("\\", "\\\\") + "%"
