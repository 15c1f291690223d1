"""Columns of an inventory row, computed from a parsed listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .strings import first_group, found, let, none_if_empty


def _kind_label(kind: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda case, rule: case.when(found(kind, rule[0]), rule[1]), rules, F).otherwise("")


def sector_number(location: Column, message: Column, keep_run_on: bool = False) -> Column:
    """Sector from the location, else from the message.

    ``keep_run_on`` also takes the first letter of a word that happens to
    follow the number, as in ``54`` + ``DLF`` giving ``54D``.
    """
    pattern = P.INVENTORY_SECTOR + ("" if keep_run_on else r"\b")
    number = first_group(F.concat(location, F.lit("\n"), message), pattern)
    return F.upper(F.regexp_replace(number, r"\s+", ""))


def area_number(size: Column) -> Column:
    return F.regexp_extract(size, P.FIRST_NUMBER, 0)


def accommodation(bhk: Column, kind: Column, message: Column) -> Column:
    rooms = F.concat(
        bhk,
        F.lit("BHK"),
        F.when(found(message, P.SERVANT_ROOM), " + SR").otherwise(""),
        F.when(found(message, P.STUDY_ROOM), " + STUDY").otherwise(""),
    )
    return F.when(bhk != "", rooms).otherwise(_kind_label(kind, P.TYPE_ACCOMMODATION))


def floor_label(kind: Column, message: Column) -> Column:
    value = F.coalesce(
        none_if_empty(first_group(message, P.FLOOR_WORD_FIRST)), none_if_empty(first_group(message, P.FLOOR_WORD_LAST))
    )
    codes = [F.when(found(message, rf"\b{code}\b"), F.lit(code)) for code in P.FLOOR_CODES]
    number = let(value, lambda v: F.coalesce(none_if_empty(F.regexp_extract(v, r"^\d+", 0)), F.upper(v)))
    return F.coalesce(
        number,
        *codes,
        _kind_label(kind, P.TYPE_FLOOR),
    )


def flat_number(message: Column) -> Column:
    unit = none_if_empty(F.upper(first_group(message, P.UNIT_NUMBER)))
    tower = none_if_empty(F.upper(first_group(message, P.TOWER_NUMBER)))
    block = none_if_empty(F.upper(first_group(message, P.BLOCK_NUMBER)))
    numbers = F.struct(unit.alias("unit"), tower.alias("tower"))
    return F.coalesce(
        let(numbers, lambda n: F.when(
            n["tower"].isNotNull(), F.concat_ws(" ", F.lit("T"), n["tower"], n["unit"])
        ).otherwise(n["unit"])),
        F.concat(F.lit("BLOCK "), block),
        F.lit(""),
    )


def price_label(sale: Column, rent: Column, rate: Column, message: Column) -> Column:
    """Sale prices, else rents, else rates, else a number after ``@`` in the text."""
    prices = F.filter(F.transform(F.split(sale, r"\|", -1), lambda p: F.trim(p)), lambda p: p != "")
    at = none_if_empty(F.regexp_extract(message, P.RATE_AFTER_AT_IN_PRICE, 1))
    return F.coalesce(
        none_if_empty(F.array_join(F.transform(prices, lambda p: F.concat(p, F.lit(" CR"))), " | ")),
        none_if_empty(rent),
        none_if_empty(rate),
        F.concat(F.lit("@ "), at),
        F.lit(""),
    )
