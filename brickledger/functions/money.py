"""Sale prices, rents and per-area rates of a listing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .strings import all_groups, between, fmt_number, found, match_starts

_DOUBLES = "array<double>"
_STRINGS = "array<string>"


def _amounts(line: Column, pattern: str, seen: str, after: str, comma: str, starts: Column) -> Column:
    """Every amount in ``line``: value, the area unit that follows, and offset.

    The unit is captured inside a look-ahead, so it is seen without being
    consumed and the matches stay those of ``pattern`` alone.
    """
    watched = f"{pattern}(?=({after})?)"
    none = F.array().cast("array<struct<value: double, per_area: boolean, at: int>>")
    pairs = F.zip_with(all_groups(line, watched, 1), all_groups(line, watched, 2), lambda value, unit: F.struct(
        F.regexp_replace(value, ",", comma).cast("double").alias("value"), (unit != "").alias("per_area")
    ))
    amounts = F.zip_with(pairs, starts, lambda pair, at: F.struct(
        pair["value"].alias("value"), pair["per_area"].alias("per_area"), at.alias("at")
    ))
    # most lines hold one kind of amount; the others are not read for it
    return F.when(found(line, seen), amounts).otherwise(none)


def _nearest(positions: Column, at: Column) -> Column:
    return F.array_min(F.transform(positions, lambda p: F.abs(p - at)))


def _pick(amounts: Column, keep, value) -> Column:
    return F.transform(F.filter(amounts, keep), value)


def money(text: Column, deal: Column | None = None) -> Column:
    """``struct<sale array<double>, rent array<double>, rates array<string>>``.

    Sale is in crore, rent in rupees a month.  An amount is a rent when the
    nearest rent word on its line is no farther than the nearest sale word; on
    a line with neither, ``deal`` decides.
    """
    no_offsets = F.array().cast("array<int>")
    rent_deal = F.lit(False) if deal is None else F.coalesce(deal == "Rent", F.lit(False))

    with_amounts = F.filter(F.split(text, "\n", -1), lambda line: found(line, P.AMOUNT_SEEN))

    # Each stage below is a transform of its own: a lambda variable is computed
    # once, whereas a repeated expression would be computed at every use.
    marked = F.transform(with_amounts, lambda line: F.struct(
        line.alias("line"),
        found(line, P.RENT_WORDS).alias("rent_word"),
        found(line, P.SALE_WORDS).alias("sale_word"),
    ))

    def read(x: Column) -> Column:
        line, both = x["line"], x["rent_word"] & x["sale_word"]

        def offsets(pattern: str) -> Column:
            return F.when(both, match_starts(line, pattern)).otherwise(no_offsets)

        return F.struct(
            both.alias("both"),
            F.when(x["rent_word"], F.lit(True)).when(x["sale_word"], F.lit(False)).otherwise(rent_deal)
            .alias("rent_line"),
            offsets(P.RENT_WORDS).alias("rent_at"),
            offsets(P.SALE_WORDS).alias("sale_at"),
            (~x["rent_word"] & found(line, P.AREA_UNIT_BEFORE_AT)).alias("rate_line"),
            _amounts(line, P.CRORE, P.CRORE_SEEN, P.AREA_UNIT_AFTER, ".", no_offsets).alias("crore"),
            _amounts(line, P.LAKH, P.LAKH_SEEN, P.AREA_UNIT_AFTER, ".", offsets(P.LAKH)).alias("lakh"),
            _amounts(line, P.THOUSAND, P.THOUSAND_SEEN, P.AREA_UNIT_AFTER, ".", offsets(P.THOUSAND)).alias("thousand"),
            _amounts(
                line, P.PLAIN_AMOUNT, P.PLAIN_AMOUNT, P.any_of(P.AREA_UNIT_AFTER, P.AREA_UNIT_AFTER_PLAIN), "",
                offsets(P.PLAIN_AMOUNT),
            ).alias("plain"),
        )

    def classify(x: Column) -> Column:
        def unit(a: Column) -> Column:
            return a["per_area"]

        def rent(a: Column) -> Column:
            return F.when(
                x["both"], _nearest(x["rent_at"], a["at"]) <= _nearest(x["sale_at"], a["at"])
            ).otherwise(x["rent_line"])

        def rate(suffix: str):
            return lambda a: F.concat(fmt_number(a["value"]), F.lit(suffix))

        crore = F.filter(x["crore"], lambda a: between(a["value"], P.CRORE_RANGE))
        return F.struct(
            F.concat(
                _pick(crore, lambda a: ~unit(a), lambda a: a["value"]),
                _pick(
                    x["lakh"],
                    lambda a: ~unit(a) & ~rent(a) & between(a["value"], P.LAKH_SALE_RANGE),
                    lambda a: a["value"] / F.lit(100.0),
                ),
            ).alias("sale"),
            F.concat(
                _pick(
                    x["lakh"],
                    lambda a: ~unit(a) & between(a["value"], P.LAKH_RENT_RANGE) & rent(a),
                    lambda a: a["value"] * F.lit(100000.0),
                ),
                _pick(
                    x["thousand"],
                    lambda a: ~unit(a) & ~x["rate_line"] & between(a["value"], P.THOUSAND_RENT_RANGE) & rent(a),
                    lambda a: a["value"] * F.lit(1000.0),
                ),
                _pick(
                    x["plain"],
                    lambda a: ~unit(a) & between(a["value"], P.PLAIN_RENT_RANGE) & rent(a),
                    lambda a: a["value"],
                ),
            ).alias("rent"),
            F.concat(
                _pick(crore, unit, rate(" Cr/unit")),
                _pick(
                    x["lakh"],
                    lambda a: unit(a) & between(a["value"], P.LAKH_RATE_RANGE),
                    rate(" L/unit"),
                ),
                _pick(x["thousand"], lambda a: ~unit(a) & x["rate_line"], rate(" K/unit")),
            ).alias("rates"),
        )

    lines = F.transform(F.transform(marked, read), classify)
    empty = F.struct(
        F.array().cast(_DOUBLES).alias("sale"),
        F.array().cast(_DOUBLES).alias("rent"),
        F.array().cast(_STRINGS).alias("rates"),
    )
    # one pass over the classified lines, each field kept in order of first sight
    return F.aggregate(
        lines,
        empty,
        lambda acc, x: F.struct(
            F.concat(acc["sale"], x["sale"]).alias("sale"),
            F.concat(acc["rent"], x["rent"]).alias("rent"),
            F.concat(acc["rates"], x["rates"]).alias("rates"),
        ),
        lambda acc: F.struct(
            F.array_distinct(acc["sale"]).alias("sale"),
            F.array_distinct(acc["rent"]).alias("rent"),
            F.array_distinct(acc["rates"]).alias("rates"),
        ),
    )
