"""Message-level text rules: folding, gates, splitting and simple fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .strings import (
    all_groups, between, digits_only, first_group, fmt_number, found, is_blank, last_ten, let, none_if_empty, title_words,
    without,
)
from .unicode import nfkc


def fold_text(c: Column) -> Column:
    """Drop carriage returns and direction marks, then fold fancy letters."""
    return nfkc(without(c, rf"[\r{P.LEFT_TO_RIGHT_MARK}]"))


def strip_format(c: Column) -> Column:
    """Drop chat mark-up and NUL, put a space for every symbol or emoji."""
    # no ASCII character is in the emoji class
    spaced = let(without(c, "[*_~`]"), lambda plain: F.when(
        F.octet_length(plain) == F.length(plain), plain
    ).otherwise(F.regexp_replace(plain, P.EMOJI, " ")))
    return without(spaced, r"\x00")


def is_noise(c: Column) -> Column:
    """Acknowledgements, deleted messages and placeholders for media."""
    placeholder = F.lower(c).contains(P.MEDIA_MARK) & (F.length(c) < P.MEDIA_MARK_LIMIT)
    return is_blank(c) | placeholder | found(c, P.NOISE)


def has_listing(c: Column) -> Column:
    """A size, a bedroom count, a crore price or a property word is present."""
    return found(c, P.any_of(P.BHK_SEEN, P.SIZE_SEEN, P.CRORE_SEEN, P.LISTING_BODY))


def chunks(body: Column) -> Column:
    """Split a message into its listings.

    Blocks between blank or rule lines are joined again until a block that
    opens a new ad meets a buffer that already holds a price, size or bedroom
    count.  One ad, or none, gives the whole body.
    """
    blocks = F.filter(F.split(body, P.BLOCK_BREAK, -1), lambda b: ~is_blank(b))
    complete = P.any_of(P.CRORE_SEEN, P.LAKH_SEEN, P.SIZE_SEEN, P.BHK_SEEN)
    # A value can reach over a block border only through such characters, so
    # the tail of the buffer is all that must be read again with a new block.
    reach = P.ci(r"[0-9\s.,&/+andto]*\z")

    def opens(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        return found(head, P.any_of(P.PROJECT_HINTS, P.SECTOR)) | ~found(
            block, P.any_of(P.BHK_SEEN, P.SIZE_SEEN, P.CRORE_SEEN, P.BLOCK_SIGNAL)
        )

    def state(done: Column, text: Column, ready: Column, tail: Column) -> Column:
        return F.struct(done.alias("done"), text.alias("text"), ready.alias("ready"), tail.alias("tail"))

    def step(acc: Column, block: Column) -> Column:
        flush = acc["text"].isNotNull() & acc["ready"] & opens(block)
        fresh = flush | acc["text"].isNull()
        seen = F.when(fresh, block).otherwise(F.concat(acc["tail"], F.lit("\n"), block))
        return state(
            F.when(flush, F.array_append(acc["done"], acc["text"])).otherwise(acc["done"]),
            F.when(fresh, block).otherwise(F.concat(acc["text"], F.lit("\n"), block)),
            (~fresh & acc["ready"]) | found(seen, complete),
            F.regexp_extract(seen, reach, 0),
        )

    none = state(
        F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(False), F.lit("").cast("string")
    )
    parts = F.aggregate(blocks, none, step, lambda acc: F.array_append(acc["done"], acc["text"]))
    whole = F.array(body)
    return (
        F.when(body.isNull(), F.lit(None))
        .when(~body.rlike(P.BLOCK_BREAK), whole)
        .otherwise(let(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(whole)))
    )


def deal_type(c: Column) -> Column:
    """Requirement, Sale, Rent, Sale / Rent or Other."""
    wanted, rent, sale = found(c, P.DEAL_REQUIREMENT), found(c, P.DEAL_RENT), found(c, P.DEAL_SALE)
    words = F.struct(wanted.alias("wanted"), rent.alias("rent"), sale.alias("sale"))
    return let(words, lambda w: (
        F.when(w["wanted"] & ~found(c, P.DEAL_AVAILABLE), "Requirement")
        .when(w["rent"] & w["sale"], "Sale / Rent")
        .when(w["rent"], "Rent")
        .when(w["sale"], "Sale")
        .when(w["wanted"], "Requirement")
        .otherwise("Other")
    ))


def property_type(c: Column) -> Column:
    """The first property kind named, or an empty string."""
    kinds = [F.when(found(c, pattern), F.lit(label)) for label, pattern in P.PROPERTY_TYPES]
    # one scan for all but the last, which most texts are
    other = F.when(found(c, P.any_of(*[pattern for _, pattern in P.PROPERTY_TYPES[:-1]])), F.coalesce(*kinds[:-1]))
    return F.when(c.isNotNull(), F.coalesce(other, kinds[-1], F.lit("")))


def bhk(c: Column) -> Column:
    """Distinct bedroom counts in rising order, as doubles."""
    numbers = F.flatten(F.transform(
        all_groups(c, P.BHK), lambda group: F.regexp_extract_all(group, F.lit(P.BHK_NUMBER), F.lit(0))
    ))
    counts = F.transform(numbers, lambda n: n.cast("double"))
    return F.array_sort(F.array_distinct(F.filter(counts, lambda n: between(n, P.BHK_RANGE))))


def bhk_label(counts: Column) -> Column:
    return F.array_join(
        F.transform(counts, lambda n: F.when(n % 1 == 0, n.cast("int").cast("string")).otherwise(n.cast("string"))),
        "/",
    )


def sizes(c: Column) -> Column:
    """Distinct areas in order of mention, as ``"1500 sq.ft"`` or ``"200 sq.yd"``."""
    # the number is what stands before the blanks and letters of the unit
    pairs = F.transform(all_groups(c, P.SIZE, 0), lambda size: F.struct(
        without(F.regexp_extract(size, r"^[\d.,]+", 0), ",").cast("double").alias("value"),
        F.when(found(size, P.SIZE_IN_YARDS), " sq.yd").otherwise(" sq.ft").alias("unit"),
    ))
    kept = F.filter(pairs, lambda p: between(p["value"], P.SIZE_RANGE))
    return F.array_distinct(F.transform(kept, lambda p: F.concat(fmt_number(p["value"]), p["unit"])))


def rate_psf(c: Column) -> Column:
    """Rate per area: the first one in range, else the one after an ``@``."""
    per_area = F.filter(
        F.transform(all_groups(c, P.RATE_PER_AREA), lambda n: n.cast("int")), lambda n: between(n, P.AREA_RATE_RANGE)
    )
    after_at = none_if_empty(first_group(c, P.RATE_AFTER_AT)).cast("int")
    return F.when(c.isNotNull(), F.coalesce(
        F.get(per_area, 0).cast("string"),
        F.when(between(after_at, P.AREA_RATE_RANGE), F.concat(F.lit("@ "), after_at.cast("string"))),
        F.lit(""),
    ))


def sectors(c: Column) -> Column:
    """Every sector number named, without blanks, in upper case."""
    return F.transform(all_groups(c, P.SECTOR), lambda s: F.upper(F.regexp_replace(s, r"\s+", "")))


def location(c: Column) -> Column:
    """The first two sectors and the first locality, joined by commas."""
    named = F.transform(F.slice(sectors(c), 1, 2), lambda s: F.concat(F.lit("Sector "), s))
    # a scan alone costs far less than the search for the place named first
    locality = title_words(F.when(found(c, P.LOCALITY), first_group(c, P.LOCALITY, 0)).otherwise(""))
    return F.array_join(F.array_distinct(
        F.concat(named, F.filter(F.array(locality), lambda part: part != ""))
    ), ", ")


def phones(c: Column) -> Column:
    """Mobile numbers in order of mention, ten digits each."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(P.PHONE), F.lit(1)), lambda p: last_ten(digits_only(p))
    )
