"""Who offers a listing: dealer names, phones and sender identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import computed_once
from . import patterns as P
from .strings import (
    capitalise, digits_only, first_filled, first_group, found, is_blank, last_ten, let, strip,
)
from .text import fold_text, strip_format
from .unicode import needs_plain, plain_letters, plain_letters_each

_TEXTS = "array<string>"


def format_dealer_name(c: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(strip(c), P.NAME_MARKS, ""), r"\s+", -1), lambda w: ~is_blank(w))
    return F.array_join(
        F.transform(words, lambda w: F.when(F.lower(w).isin("and", "&"), F.lower(w)).otherwise(capitalise(w))), " "
    )


def _bare_name(c: Column) -> Column:
    return let(strip(c), lambda name: F.when(
        name.rlike(P.NAME_MARKS), strip(F.regexp_replace(name, P.NAME_MARKS, ""))).otherwise(name))


def _acceptable(bare: Column, plain: Column, registry) -> Column:
    """Name rules on a bare candidate; ``plain`` is its accent-free form."""
    return (
        F.length(bare).between(*P.NAME_LENGTHS)
        & ~bare.rlike(r"\p{Nd}")
        & (F.length(F.regexp_replace(bare, r"\P{L}+", "")) >= P.NAME_LETTERS)
        & ~found(bare, P.NOT_A_DEALER)
        & (~found(bare, P.PROJECT_HINTS) | found(bare, P.AGENCY_WORDS))
        & ~registry.is_selected_plain(plain)
    )


def valid_dealer_name(c: Column, registry) -> Column:
    return F.coalesce(_acceptable(_bare_name(c), plain_letters(_bare_name(c)), registry), F.lit(False))


def clean_for_names(c: Column) -> Column:
    return strip_format(fold_text(c))


def _signed(clean: Column) -> Column:
    return F.array(*[strip(first_group(clean, p)) for p in P.SIGNATURES])


def name_candidates(clean: Column, signatures: Column | None = None) -> Column:
    """Possible dealer names in order of preference, as an array of strings.

    First the words after a signature phrase; then, for every line with a
    phone, the words before it, after it and on the two lines above; last an
    agency line.  ``clean`` is the result of ``clean_for_names``.
    """
    signatures = _signed(clean) if signatures is None else signatures

    lines = F.filter(F.transform(F.split(clean, "\n", -1), strip), lambda line: line != "")
    # one struct per line with a phone: the text around the first, and the lines above
    around = let(lines, lambda ls: F.transform(ls, lambda line, i: F.when(line.rlike(P.PHONE), F.struct(
        F.split(line, P.PHONE, 2).alias("sides"),
        F.reverse(F.slice(ls, F.greatest(i - (P.LINES_ABOVE_PHONE - 1), F.lit(1)),
                          F.least(i, F.lit(P.LINES_ABOVE_PHONE)))).alias("above"),
    ))))
    with_phone = F.filter(around, lambda x: x.isNotNull())

    def unsigned(c: Column) -> Column:
        return strip(F.regexp_replace(c, P.CALL_SIGNS, " "))

    def words(c: Column) -> Column:
        return F.filter(F.split(c, r"\s+", -1), lambda w: w != "")

    def ends(ws: Column, last: bool) -> Column:
        picks = [
            F.when(F.size(ws) >= n, F.array_join(F.slice(ws, -n if last else 1, n), " "))
            for n in range(P.NAME_WORDS, 0, -1)
        ]
        return F.array(*picks)

    parted = F.transform(with_phone, lambda x: F.struct(
        unsigned(x["sides"][0]).alias("before"), unsigned(x["sides"][1]).alias("after"), x["above"].alias("above")
    ))
    worded = F.transform(parted, lambda x: F.struct(
        x["before"].alias("before"), words(x["before"]).alias("before_words"),
        x["after"].alias("after"), words(x["after"]).alias("after_words"),
        F.filter(F.transform(x["above"], unsigned), lambda line: ~line.rlike(P.PHONE)).alias("above"),
    ))
    beside_phones = F.flatten(F.transform(worded, lambda x: F.concat(
        F.array(x["before"]), ends(x["before_words"], True),
        F.array(x["after"]), ends(x["after_words"], False),
        x["above"],
    )))
    none = F.array().cast(_TEXTS)
    # a scan for the words alone costs far less than the search for the line
    agency = F.array(F.when(found(clean, P.AGENCY_KINDS), strip(first_group(clean, P.AGENCY_LINE))))
    candidates = F.concat(signatures, F.when(clean.rlike(P.PHONE), beside_phones).otherwise(none), agency)
    return F.when(clean.isNotNull(), _long_enough(candidates))


def _long_enough(names: Column) -> Column:
    return F.filter(names, lambda name: F.length(name) >= P.NAME_LENGTHS[0])


def best_name(bare: Column, plain: Column, registry) -> Column:
    """First acceptable candidate in display form, else an empty string."""
    pairs = F.zip_with(bare, plain, lambda b, p: F.struct(b.alias("bare"), p.alias("plain")))
    # none is tested after the first that is accepted
    first = F.aggregate(pairs, F.lit(None).cast("string"), lambda name, x: F.coalesce(
        name, F.when(_acceptable(x["bare"], x["plain"], registry), x["bare"])))
    return F.coalesce(format_dealer_name(first), F.lit(""))


def bare_candidates(clean: Column, registry) -> Column:
    """Candidates without marks; the first alone if it is sure to be accepted, since none after it is looked at then."""
    def sure(bare: Column) -> Column:
        return ~needs_plain(bare) & _acceptable(bare, bare, registry)

    def listed(signatures: Column) -> Column:
        every = F.transform(name_candidates(clean, signatures), _bare_name)
        return let(_bare_name(F.get(_long_enough(signatures), 0)), lambda first: F.when(
            sure(first), F.array(first)).otherwise(every))

    return F.when(clean.isNotNull(), let(_signed(clean), listed))


def with_dealer_name(df: DataFrame, text: str, name: str, registry) -> DataFrame:
    """Add the human or agency name found in a text column, or an empty string.

    The text is finished before candidates are drawn from it: Spark does not
    run two Python functions, one inside the other, in a single projection.
    """
    return (
        computed_once(df, _clean=clean_for_names(F.col(text)))
        .withColumn("_bare", bare_candidates(F.col("_clean"), registry))
        .withColumn("_plain", plain_letters_each(F.col("_bare")))
        .withColumn(name, best_name(F.col("_bare"), F.col("_plain"), registry))
        .drop("_clean", "_bare", "_plain")
    )


# -- sender identities ------------------------------------------------------

def is_lid(c: Column) -> Column:
    """An opaque linked identity: never shown as a name or phone."""
    digits = F.regexp_replace(c, r"\P{Nd}+", "")
    return F.coalesce(
        ~is_blank(c) & (
            F.lower(c).contains(P.LID_MARK)
            | ((F.length(digits) >= P.LID_DIGITS) & (F.length(digits) == F.length(strip(c))))
        ),
        F.lit(False),
    )


def clean_sender(c: Column) -> Column:
    return strip(F.substring_index(c, "@", 1))


def phone_of(c: Column) -> Column:
    """Last ten digits, or an empty string when there are fewer."""
    return let(last_ten(digits_only(c)), lambda digits: F.when(F.length(digits) == 10, digits).otherwise(""))


def listing_phone(contact: Column, posted_by: Column) -> Column:
    """First contact number, else the digits of a poster who is no LID."""
    return first_filled(
        phone_of(F.substring_index(contact, ",", 1)),
        F.when(~is_lid(posted_by), phone_of(posted_by)),
    )


def listing_dealer(name_in_text: Column, posted_by: Column, phone: Column) -> Column:
    """Name in the text, the poster, the phone, or the catch-all label."""
    return first_filled(
        name_in_text, F.when(~is_lid(posted_by), clean_sender(posted_by)), phone, F.lit(P.NO_DEALER)
    )


def posted_dealer(name_in_text: Column, template: Column, template_phone: Column, sender: Column) -> Column:
    """Dealer of one post of a parsed text.

    The parsed template knows no sender; each post adds its own.
    """
    usable = ~is_blank(template) & ~is_lid(template) & (F.lower(template) != P.NO_DEALER.lower())
    return first_filled(
        name_in_text,
        F.when(usable, template),
        F.when(~is_lid(sender), clean_sender(sender)),
        template_phone,
        phone_of(clean_sender(sender)),
        F.lit(P.NO_DEALER),
    )


def posted_phone(template_phone: Column, sender: Column) -> Column:
    return first_filled(template_phone, phone_of(clean_sender(sender)))

