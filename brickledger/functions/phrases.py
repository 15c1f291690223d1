"""Phrases found by look-up: the cost of a text does not grow with the number of phrases.

The table is one constant array of buckets.  The first pieces of a phrase, by
their CRC-32, give its bucket; the same is done at every place of a text, and
only the phrases met there are tested.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import let

MOST_PIECES = 4  # of a phrase that make its key
# Words as they end at a word border, whether that minds letters beyond ASCII or not
WORDS = r"[A-Za-z0-9]+|[\p{L}\p{Nd}&&[^A-Za-z0-9]]+"
# Letters that are another one without regard to case, though their lower case differs
ODD_CASE = "[Kſ]"


def folded(c: Column) -> Column:
    return F.lower(F.upper(c))


def is_odd(c: Column) -> Column:
    """True for texts whose letters cannot be compared one by one in lower case."""
    return c.rlike(ODD_CASE) | (F.char_length(folded(c)) != F.char_length(c))


@dataclass(frozen=True)
class Phrase:
    ord: int  # the least of several that are met counts
    pieces: tuple[str, ...]
    test: str  # what ``accept`` gets
    project: str


def first_accepted(entries: Column, accept: Callable[[Column], Column]) -> Column:
    return let(F.get(F.filter(entries, lambda e: accept(e["test"])), 0), lambda e: F.when(
        e.isNotNull(), F.struct(e["ord"].alias("ord"), e["project"].alias("project"))))


def every_one(phrases: Sequence[Phrase], accept: Callable[[Column], Column]) -> Column:
    """As ``looked_up``, by testing every phrase."""
    listed = [{"ord": p.ord, "test": p.test, "project": p.project} for p in phrases]
    return first_accepted(F.from_json(F.lit(json.dumps(listed)), "array<struct<ord: int, test: string, project: string>>"), accept)


def looked_up(pieces: Column, phrases: Sequence[Phrase], accept: Callable[[Column], Column]) -> Column:
    """``(ord, project)`` of the first phrase that is met in ``pieces`` and whose ``test`` is accepted, else null."""
    if not phrases:
        return F.lit(None).cast("struct<ord: int, project: string>")
    size = 2 * len(phrases) + 1
    buckets: list[list[dict]] = [[] for _ in range(size)]
    lengths = sorted({min(len(p.pieces), MOST_PIECES) for p in phrases})
    for p in phrases:
        key = " ".join(p.pieces[:MOST_PIECES])
        buckets[zlib.crc32(key.encode()) % size].append({"ord": p.ord, "key": key, "test": p.test, "project": p.project})
    kind = "array<array<struct<ord: int, key: string, test: string, project: string>>>"
    table = F.from_json(F.lit(json.dumps(buckets)), kind)

    def at(here: Column, buckets: Column, start: Column, length: int) -> Column:
        key = F.array_join(F.slice(here, start, length), " ")
        return let(key, lambda k: F.filter(
            F.get(buckets, F.pmod(F.crc32(k.cast("binary")), F.lit(size)).cast("int")), lambda e: e["key"] == k))

    def met(here: Column, buckets: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(here))
        found = F.flatten(F.transform(places, lambda i: F.flatten(F.array(*[at(here, buckets, i, n) for n in lengths]))))
        return first_accepted(F.array_sort(F.array_distinct(found)), accept)

    some = let(pieces, lambda here: let(table, lambda buckets: met(here, buckets)))
    return F.when(F.size(pieces) > 0, some)
