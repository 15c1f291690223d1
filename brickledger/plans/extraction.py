"""From message texts to listings.

``parse_texts`` is the common job: it works on any table with a ``text``
column, carries every other column along and needs no shuffle.  The gate runs
before anything costly, and dealer and project rules run only on parts that
turned out to hold a price, a size, a bedroom count or a rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dealer as D
from ..functions import patterns as P
from ..functions import rows as R
from ..functions import text as T
from ..functions.money import money
from ..functions.project import project
from ..functions.strings import first_filled, fmt_number, fmt_rent, is_blank, let, safe_take, strip
from ..functions.unicode import plain_letters, plain_letters_each
from ..operators.ranking import running_number
from ..operators.skew import ROWS_PER_TASK, heavy_keys, spread_join
from ..operators.staging import built_once, computed_once
from ..operators.storage import stored
from ..registry import Registry

# Raise when extraction, project selection or field conversion change.
EXTRACTOR_VERSION = "listing-rules-1"

# Typed fields of a parsed listing; none depends on who posted it.
TYPED_FIELDS = ["bhk_values", "sizes", "sale_cr", "rent_inr", "rates", "phones"]
PARSED_FIELDS = [
    "part_no", "n_parts", "deal_type", "property_type", "project_or_society", "canonical", "location", "bhk", "size",
    "sale_price_cr", "rent_per_month", "rate_per_sqft", "contact_no", "name_in_part", "name_in_message",
    "name_in_text", "full_message",
]


def _only(df: DataFrame, name: str, condition: Column, keep_empty: bool) -> DataFrame:
    """Drop the rows that fail, or keep them with ``name`` set to null."""
    if keep_empty:
        return df.withColumn(name, F.when(condition, F.col(name)))
    return df.filter(condition)


@built_once
def _gate() -> tuple[Column, Column]:
    body = F.col("body")
    return T.fold_text(strip(F.col("text"))), ~T.is_noise(body) & T.has_listing(T.strip_format(body))


def listing_texts(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    """The gate: replace ``text`` by the folded ``body`` of messages that may hold a listing."""
    carried = [c for c in df.columns if c != "text"]
    present = df if keep_empty else df.filter(~is_blank(F.col("text")))
    folded, passed = _gate()
    return _only(computed_once(present, body=folded).select(*carried, "body"), "body", passed, keep_empty)


@built_once
def _message_columns() -> dict[str, Column]:
    whole = F.col("whole")
    return {"deal_whole": T.deal_type(whole), "phones_whole": T.phones(whole), "pieces": T.chunks(F.col("body"))}


# What is known of a message need not be found again in its only part.
def _of_part(known: Column, own: Column) -> Column:
    return F.when(F.col("n_parts") == 1, known).otherwise(own)


@built_once
def _part_columns() -> tuple[Column, Column]:
    clean = _of_part(F.col("whole"), T.strip_format(F.col("piece")))
    # a part that says nothing about the deal takes that of its message
    deal = let(T.deal_type(F.col("clean")), lambda d: F.when(d == "Other", F.col("deal_whole")).otherwise(d))
    return clean, _of_part(F.col("deal_whole"), deal)


@built_once
def _measures() -> dict[str, Column]:
    clean = F.col("clean")
    return {
        "money": money(clean, F.col("deal_type")), "sizes": T.sizes(clean), "bhk_values": T.bhk(clean),
        "rate_psf": T.rate_psf(clean),
    }


@built_once
def _descriptions(registry: Registry) -> dict[str, Column]:
    clean, whole, stripped = F.col("clean"), F.col("whole"), strip(F.col("piece"))
    several = F.col("n_parts") > 1
    whole_location = F.when(several & (F.size(F.array_distinct(T.sectors(whole))) <= 1), T.location(whole))
    phones_whole = F.col("phones_whole")
    # a dealer is looked for in the part, then in the whole message if it has other parts
    other_parts = F.when(clean.isNotNull() & several, whole)
    return {
        "sale_cr": F.col("money.sale"), "rent_inr": F.col("money.rent"), "rates": F.col("money.rates"),
        "property_type": first_filled(T.property_type(clean), F.when(several, T.property_type(whole))),
        "project_or_society": project(clean, registry),
        "location": first_filled(T.location(clean), whole_location),
        "phones": _of_part(F.array_distinct(phones_whole), F.array_union(T.phones(clean), phones_whole)),
        "full_message": F.when(clean.isNotNull(), F.translate(stripped, "\x00", "")),
        "candidates": F.transform(F.array(clean, other_parts), lambda text: D.bare_candidates(text, registry)),
    }


@built_once
def _names(registry: Registry) -> tuple[dict[str, Column], Column]:
    plain = F.array(*[plain_letters_each(F.col("candidates")[i]) for i in range(2)])
    names = F.zip_with("candidates", plain, lambda bare, plain: D.best_name(bare, plain, registry))
    plain_project = plain_letters(F.col("project_or_society"))
    return {"names": names, "plain_project": plain_project}, registry.canonical_plain(F.col("plain_project"))


@built_once
def _display_texts() -> dict[str, Column]:
    names = F.col("names")
    return {
        "bhk": T.bhk_label(F.col("bhk_values")),
        "size": _shown(F.col("sizes")),
        "sale_price_cr": _shown(F.col("sale_cr"), fmt_number),
        "rent_per_month": _shown(F.col("rent_inr"), fmt_rent),
        "rate_per_sqft": first_filled(F.col("rate_psf"), _shown(F.col("rates"))),
        "contact_no": F.array_join("phones", ", "),
        "name_in_part": names[0],
        "name_in_message": names[1],
        "name_in_text": names[0],
    }


def parse_bodies(gated: DataFrame, registry: Registry, keep_empty: bool = False) -> DataFrame:
    """One row per listing of every ``body`` that passed the gate."""
    carried = [c for c in gated.columns if c != "body"]
    explode = F.posexplode_outer if keep_empty else F.posexplode
    whole = computed_once(computed_once(gated, whole=T.strip_format(F.col("body"))), **_message_columns())
    parts = whole.select(
        *carried, "whole", "deal_whole", "phones_whole",
        F.size("pieces").alias("n_parts"), explode("pieces").alias("part_no", "piece"),
    )
    clean, deal = _part_columns()
    measured = computed_once(computed_once(computed_once(parts, clean=clean), deal_type=deal), **_measures())
    holds_values = (
        (F.size("money.sale") > 0) | (F.size("money.rent") > 0) | (F.size("sizes") > 0) | (F.size("bhk_values") > 0)
        | (F.col("rate_psf") != "")
    )
    described = computed_once(_only(measured, "clean", holds_values, keep_empty), **_descriptions(registry)).select(
        *carried, "part_no", "n_parts", "deal_type", "bhk_values", "sizes", "rate_psf", *_descriptions(registry)
    )
    names, canonical = _names(registry)
    shown = computed_once(computed_once(described, **names), canonical=canonical, **_display_texts())
    return shown.select(*carried, *PARSED_FIELDS, *TYPED_FIELDS)


def _shown(values: Column, fmt=None, n: int | None = None) -> Column:
    kept = values if n is None else F.slice(values, 1, n)
    return F.array_join(kept if fmt is None else F.transform(kept, lambda v: fmt(v)), " | ")


def display_form(
    listings: DataFrame, sizes: int = P.SHOWN_SIZES, prices: int = P.SHOWN_PRICES, rates: int = P.SHOWN_RATES,
    phones: int = P.SHOWN_PHONES, message: int = P.MESSAGE_LIMIT,
) -> DataFrame:
    """Listings with no more than so many values and characters in their display columns.

    For showing only: keys, groups and inventory columns are made from listings that nothing was cut from.
    """
    every_rate = _shown(F.col("rates"))
    return listings.withColumns({
        "size": _shown(F.col("sizes"), n=sizes),
        "sale_price_cr": _shown(F.col("sale_cr"), fmt_number, prices),
        "rent_per_month": _shown(F.col("rent_inr"), fmt_rent, prices),
        "rate_per_sqft": F.when(F.col("rate_per_sqft") == every_rate, _shown(F.col("rates"), n=rates)).otherwise(F.col("rate_per_sqft")),
        "contact_no": F.array_join(F.slice("phones", 1, phones), ", "),
        "full_message": safe_take(F.col("full_message"), message),
    })


def parse_texts(df: DataFrame, registry: Registry, keep_empty: bool = False) -> DataFrame:
    """One row per listing found in ``text``, with ``PARSED_FIELDS`` and ``TYPED_FIELDS``.

    With ``keep_empty`` a text without listings still gives rows, with a null
    ``full_message``, so that a parse cache can remember it.
    """
    return parse_bodies(listing_texts(df, keep_empty), registry, keep_empty)


def repost_key(body: Column, limit: int | None = None) -> Column:
    """Key under which the postings of a folded message are counted; ``limit`` makes it a prefix of so many characters."""
    clean = F.lower(T.strip_format(body))
    key = F.regexp_replace(clean, "[^0-9a-z_À-ÿ]+", "")
    return key if limit is None else safe_take(key, limit)


def text_digest(text: Column) -> Column:
    """Identity of a text: SHA-256 of its UTF-8 bytes, as hex."""
    return F.sha2(text, 256)


def distinct_texts(messages: DataFrame) -> DataFrame:
    """``(digest, text, n_posts)``: every text once, reduced before the shuffle."""
    return messages.groupBy(text_digest(F.col("text")).alias("digest")).agg(
        F.first("text").alias("text"), F.count("*").alias("n_posts")
    )


def extract_listings(
    messages: DataFrame, registry: Registry, count_posts: bool = True, repost_key_limit: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Listings of ``(chat_id, message_id, timestamp_ms, sender, text)`` messages.

    Dates and times are those of the session time zone.  Without
    ``count_posts`` the running count is left at 1.

    Messages are reduced to their distinct texts before any rule runs, the
    gate included; what passed it is stored.  Each distinct body is parsed
    once; posts are numbered and joined to what was found in their text by ids
    and digests alone.
    """
    texts = listing_texts(distinct_texts(messages).withColumnRenamed("digest", "text_digest"))
    keyed = computed_once(
        texts, digest=F.sha2("body", 256), repost_key=F.md5(repost_key(F.col("body"), repost_key_limit)))
    gated = stored(keyed.select("text_digest", "n_posts", "digest", "repost_key", "body"), "gated")
    parsed = parse_bodies(gated.select("digest", "body").dropDuplicates(["digest"]), registry)
    posts = messages.select("chat_id", "message_id", "timestamp_ms", "sender", text_digest(F.col("text")).alias("text_digest"))
    heavy_texts = heavy_keys(gated, "text_digest", "n_posts", rows_per_task)
    keys = gated.select("text_digest", "digest", "repost_key")
    posts = spread_join(posts, keys, "text_digest", heavy_texts, ["chat_id", "message_id"]).drop("text_digest")
    if count_posts:
        posts = running_number(stored(posts, "posts"), F.col("repost_key"), "chat_id", "message_id", "times_posted")
    else:
        posts = posts.withColumn("times_posted", F.lit(1))
    copies = gated.groupBy("digest").agg(F.sum("n_posts").alias("n_posts"))
    heavy = heavy_keys(copies, "digest", "n_posts", rows_per_task)
    counted = spread_join(posts.drop("repost_key"), parsed, "digest", heavy, ["chat_id", "message_id"])
    posted_at = F.timestamp_millis("timestamp_ms")
    several = F.concat((F.col("part_no") + 1).cast("string"), F.lit(" of "), F.col("n_parts").cast("string"))
    return counted.select(
        "chat_id", "message_id", "part_no", "timestamp_ms",
        F.date_format(posted_at, "dd/MM/yy").alias("date"),
        F.date_format(posted_at, "HH:mm").alias("time"),
        first_filled(F.col("name_in_part"), F.col("name_in_message"), F.col("sender")).alias("posted_by"),
        "deal_type", "property_type", "project_or_society", "location", "bhk", "size", "sale_price_cr",
        "rent_per_month", "rate_per_sqft", "contact_no",
        F.when(F.col("n_parts") > 1, several).otherwise("").alias("listing_in_msg"),
        "times_posted", "full_message", "canonical", "name_in_text", *TYPED_FIELDS,
    )


@built_once
def registered(registry: Registry) -> Column:
    """``struct<society, status>`` of a listing: IN with its registered name, else OUT."""
    canonical = first_filled(F.col("canonical"), registry.canonical_in_text(F.col("full_message")))
    return let(canonical, lambda name: F.struct(
        first_filled(name, F.col("project_or_society")).alias("society"),
        F.when(name == "", "OUT").otherwise("IN").alias("status"),
    ))


@built_once
def display_fields(keep_run_on: bool = False) -> dict[str, Column]:
    """Inventory columns that depend on neither dealer nor registry."""
    message, kind = F.col("full_message"), F.col("property_type")
    return {
        "sec": R.sector_number(F.col("location"), message, keep_run_on),
        "area": R.area_number(F.col("size")),
        "acco": R.accommodation(F.col("bhk"), kind, message),
        "floor": R.floor_label(kind, message),
        "flat_no": R.flat_number(message),
        "price": R.price_label(F.col("sale_price_cr"), F.col("rent_per_month"), F.col("rate_per_sqft"), message),
    }


def with_registry_columns(listings: DataFrame, registry: Registry) -> DataFrame:
    """Add ``canonical`` and ``name_in_text`` to listings that came without them."""
    if "canonical" not in listings.columns:
        listings = listings.withColumn("canonical", registry.canonical_name(F.col("project_or_society")))
    if "name_in_text" not in listings.columns:
        listings = D.with_dealer_name(listings, "full_message", "name_in_text", registry)
    return listings


@built_once
def _contact_columns() -> tuple[Column, Column]:
    phone = D.listing_phone(F.col("contact_no"), F.col("posted_by"))
    return phone, D.listing_dealer(F.col("name_in_text"), F.col("posted_by"), F.col("phone"))


def to_inventory_rows(listings: DataFrame, registry: Registry, keep_run_on: bool = False) -> DataFrame:
    """Inventory rows of extracted listings: society, status, dealer, phone and display fields."""
    phone, dealer = _contact_columns()
    named = with_registry_columns(listings, registry)
    rows = computed_once(named, registered=registered(registry), phone=phone, **display_fields(keep_run_on))
    return computed_once(rows, dealer=dealer).select(
        *named.columns, F.col("registered.society").alias("society"), F.col("registered.status").alias("status"),
        *display_fields(keep_run_on), "phone", "dealer",
    )


def templates(df: DataFrame, registry: Registry, keep_empty: bool = False) -> DataFrame:
    """Inventory rows of texts alone, before any sender is known.

    ``df`` needs a ``text`` column; the others are carried along.
    """
    carried = [c for c in df.columns if c != "text"]
    parsed = parse_texts(df, registry, keep_empty).withColumn(
        "posted_by", first_filled(F.col("name_in_part"), F.col("name_in_message"))
    )
    return to_inventory_rows(parsed, registry).select(
        *carried, "part_no", "society", "status", "sec", "area", "acco", "floor", "flat_no", "dealer", "phone", "price",
        "full_message", "name_in_text",
    )
