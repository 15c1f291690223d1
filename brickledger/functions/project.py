"""The project or society a listing names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .strings import first_filled, first_group, found, let, strip, strip_edges
from .text import strip_format


def prefixed_title(c: Column) -> Column:
    """The words after "in", "at", "project:", "society:" or "location:", or null."""
    title = strip(strip_edges(strip_format(first_group(c, P.PROJECT_AFTER_PREFIX)), P.LINE_EDGE))
    return let(title, lambda t: F.when(
        F.length(t).between(*P.PREFIXED_TITLE_LENGTHS)
        & ~found(t, P.GENERIC_TITLE)
        & ~found(t, P.HEADLINE),
        t,
    ))


def _shorten(line: Column) -> Column:
    """Cut the listing details off a long line; null when it is no title at all."""
    head = first_group(line, r"\A([\s\S]*?)" + P.DETAIL_CUT)
    return (
        F.when(F.length(line) <= P.LONG_LINE, line)
        .when(found(line, P.DETAIL_CUT) & (F.length(head) > 3), strip(head))
        .when(F.length(line) <= P.OVERLONG_LINE, line)
    )


def _score(line: Column, letters: Column, index: Column) -> Column:
    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    return (
        points(found(line, P.PROJECT_HINTS), P.SCORE_HINT)
        + points(found(line, P.SECTOR), P.SCORE_SECTOR)
        - points(found(line, P.DETAIL_LINE), P.SCORE_DETAIL)
        - points(line.rlike(r"\A\p{Nd}"), P.SCORE_LEADING_DIGIT)
        - points(letters.cast("double") / F.length(line) < P.LETTER_SHARE, P.SCORE_FEW_LETTERS)
        + F.greatest(F.lit(0.0), F.lit(P.SCORE_FIRST_LINE) - index * F.lit(P.SCORE_LINE_STEP))
    )


def best_title_line(c: Column) -> Column:
    """The line that looks most like a project title; the earlier one on a tie."""
    def tidy(marked: Column) -> Callable[[Column, Column], Column]:
        def of(line: Column, index: Column) -> Column:
            bare = F.when(marked, strip_format(line)).otherwise(line)
            text = F.regexp_replace(strip_edges(bare, P.LINE_EDGE), r"\s{2,}", " ")
            return F.struct(text.alias("line"), index.alias("index"))

        return of

    def shorten(x: Column) -> Column:
        return F.struct(_shorten(x["line"]).alias("line"), x["index"].alias("index"))

    def count(x: Column) -> Column:
        letters = F.length(F.regexp_replace(x["line"], "[^A-Za-z]+", ""))
        return F.struct(x["line"].alias("line"), x["index"].alias("index"), letters.alias("letters"))

    def is_title(x: Column) -> Column:
        line = x["line"]
        return (
            (x["letters"] >= P.SHORTEST_TITLE)
            & ~line.rlike(P.PHONE)
            & ~found(line, P.HEADLINE)
            & ~found(line, P.GENERIC_TITLE)
            & ~found(line, P.GENERIC_UNIT)
        )

    lines = let(c.rlike(P.FORMAT_MARKS), lambda marked: F.transform(F.split(c, "\n", -1), tidy(marked)))
    tidied = F.filter(lines, lambda x: F.length(x["line"]) > 3)
    short = F.filter(F.transform(tidied, shorten), lambda x: x["line"].isNotNull())
    titles = F.filter(F.transform(short, count), is_title)
    scored = F.transform(titles, lambda x: F.struct(
        _score(x["line"], x["letters"], x["index"]).alias("score"),
        (-x["index"]).alias("earlier"),
        x["line"].alias("line"),
    ))
    return F.array_max(scored)["line"]


def clean_title(c: Column) -> Column:
    for pattern in P.TITLE_CLEANUPS:
        c = F.regexp_replace(c, P.ci(pattern), "")
    c = F.split(c, P.ci(P.TITLE_END), -1)[0]
    return F.translate(strip_edges(c, P.TITLE_EDGE), "\x00", "")


def project(c: Column, registry) -> Column:
    """A registered project named in the text, else a prefixed title, else the best line."""
    return F.when(c.isNotNull(), first_filled(
        registry.canonical_in_text(c), prefixed_title(c), clean_title(best_title_line(c))
    ))
