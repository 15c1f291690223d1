"""Small Column helpers shared by the extraction rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .scans import quick


def strip(c: Column) -> Column:
    """Trim every kind of Unicode blank, not only the space character."""
    return F.trim(c, F.lit(P.WHITESPACE))


def strip_edges(c: Column, edges: str) -> Column:
    return F.trim(c, F.lit(edges))


def without(c: Column, marks: str) -> Column:
    """``c`` without the characters of a class; a text that holds none is not copied."""
    return F.regexp_replace(c, marks, "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it.

    Naming a Column twice doubles its expression tree, and nesting that a few
    levels deep makes plans explode.  A lambda variable is evaluated once.
    """
    return F.transform(F.array(value), lambda v: use(v))[0]


def none_if_empty(c: Column) -> Column:
    return let(c, lambda v: F.when(v != "", v))


def first_filled(*columns: Column) -> Column:
    """First column that is neither null nor empty; an empty string if none is."""
    return F.coalesce(*[none_if_empty(c) for c in columns], F.lit(""))


def found(c: Column, pattern: str) -> Column:
    return c.rlike(P.ci(quick(pattern)))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, P.ci(pattern), group)


def all_groups(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(P.ci(pattern)), F.lit(group))


def between(c: Column, bounds: tuple) -> Column:
    return c.between(F.lit(bounds[0]), F.lit(bounds[1]))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D+", "")


def last_ten(c: Column) -> Column:
    return F.right(c, F.lit(10))


def safe_take(c: Column, n: int) -> Column:
    """First ``n`` characters.  Spark counts code points, so no pair is ever split."""
    return F.substring(c, 1, n)


def fmt_number(n: Column) -> Column:
    """Whole numbers without a fraction, others with at most two decimals."""
    return let(n, lambda v: F.when(v % 1 == 0, v.cast("bigint").cast("string")).otherwise(
        F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", "")
    ))


def fmt_rent(n: Column) -> Column:
    lakh, thousand = F.lit(100000.0), F.lit(1000.0)
    return F.when(n >= lakh, F.concat(fmt_number(n / lakh), F.lit(" L"))).otherwise(
        F.concat(fmt_number(n / thousand), F.lit(" k"))
    )


def capitalise(word: Column) -> Column:
    return let(word, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1))))


def title_words(c: Column) -> Column:
    """Every blank-separated word in title case, joined by one space."""
    return F.array_join(F.transform(F.split(c, r"\s+", -1), capitalise), " ")


def match_starts(c: Column, pattern: str) -> Column:
    """0-based offsets of all matches, from the lengths of gaps and matches."""
    matches = all_groups(c, pattern, 0)
    gaps = F.slice(F.split(c, P.ci(pattern), -1), F.lit(1), F.size(matches))
    lengths = F.zip_with(
        gaps, matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("match"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        lengths,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["match"]).alias("at"),
            F.array_append(acc["starts"], acc["at"] + x["gap"]).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
