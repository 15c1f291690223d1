"""From messages to the deduplicated inventory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dealer as D
from ..functions.strings import first_filled
from ..operators.dedup import consolidate, earliest_per, flag_superseded, keep_earliest
from ..operators.skew import ROWS_PER_TASK, dealt, heavy_keys, spread_join
from ..operators.staging import built_once, computed_once
from ..operators.storage import replacing, stored
from ..operators.windows import recent_listings
from ..registry import Registry
from ..schemas import INVENTORY_FIELDS, POST_ORDER
from . import extraction as X
from .extraction import distinct_texts, text_digest as digest

TEMPLATE_FIELDS = [*INVENTORY_FIELDS, "name_in_text"]
PARSE_CACHE = (
    f"digest string, listings array<struct<part_no: int, {', '.join(f'{name}: string' for name in TEMPLATE_FIELDS)}>>, "
    "version string, prefix string"
)


def cache_version(registry: Registry, version: str = X.EXTRACTOR_VERSION) -> str:
    """Cached parses are valid for one set of rules and one registry only."""
    return f"{version}-{registry.fingerprint()}"


def read_parse_cache(spark, cache_path: str, version: str, digests: DataFrame | None = None) -> DataFrame | None:
    """``(digest, listings)`` of one version; null ``listings`` are damaged and left out.

    With ``digests(digest)`` only their entries are read on: other prefixes
    are not scanned, and nothing else is grouped.
    """
    try:
        cache = spark.read.schema(PARSE_CACHE).parquet(cache_path)
    except Exception as error:  # no cache has been written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    valid = cache.filter((F.col("version") == version) & F.col("listings").isNotNull())
    if digests is not None:
        valid = valid.join(digests.select("digest", cache_prefix().alias("prefix")), ["prefix", "digest"], "left_semi")
    # two runs may both have added a text
    return valid.groupBy("digest").agg(F.first("listings").alias("listings"))


def cache_prefix() -> Column:
    return F.substring("digest", 1, 1)


def compact_parse_cache(spark, cache_path: str) -> None:
    """Rewrite the cache with one entry per text and few files per prefix; run it while nothing else writes."""
    with replacing(spark, cache_path) as staged:
        once = spark.read.schema(PARSE_CACHE).parquet(cache_path).filter(F.col("listings").isNotNull()).dropDuplicates(["version", "digest"])
        once.hint("rebalance", "version", "prefix").write.partitionBy("version", "prefix").parquet(staged)


def refresh_parse_cache(
    texts: DataFrame, registry: Registry, cache_path: str, version: str = X.EXTRACTOR_VERSION
) -> DataFrame:
    """Parse the texts the cache does not know yet, add them to it and return the entries of ``texts``.

    Texts without a listing are remembered too, with an empty array.
    """
    spark, version = texts.sparkSession, cache_version(registry, version)
    known = read_parse_cache(spark, cache_path, version, texts)
    new = texts.select("digest", "text")
    if known is not None:
        new = new.join(known.select("digest"), "digest", "left_anti")
    # stored, so that the long plan of the rules is analysed and optimised once
    rows = stored(X.templates(dealt(new, "digest"), registry, keep_empty=True), "templates")
    listing = F.when(F.col("full_message").isNotNull(), F.struct("part_no", *TEMPLATE_FIELDS))
    # a group here holds the listings of one text, never more
    parsed = rows.groupBy("digest").agg(F.sort_array(F.collect_list(listing)).alias("listings"))
    entries = parsed.withColumns({"version": F.lit(version), "prefix": cache_prefix()})
    # few files for each prefix, but as many tasks as the entries need
    entries.hint("rebalance", "prefix").write.mode("append").partitionBy("version", "prefix").parquet(cache_path)
    return read_parse_cache(spark, cache_path, version, texts)


def extract_once(
    messages: DataFrame,
    registry: Registry,
    cache_path: str | None = None,
    version: str = X.EXTRACTOR_VERSION,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Template rows of every message, parsing each distinct text once.

    With ``cache_path`` texts parsed by earlier runs are not parsed again.
    The result has a row per message and listing, without text or sender rules.
    """
    posts = messages.select(
        "chat_id", "message_id", "timestamp_ms", "sender", digest(F.col("text")).alias("digest")
    )
    texts = stored(distinct_texts(messages))
    if cache_path is None:
        parsed = X.templates(dealt(texts.select("digest", "text"), "digest"), registry)
    else:
        parsed = refresh_parse_cache(texts, registry, cache_path, version).select("digest", F.inline("listings"))
    heavy = heavy_keys(texts, "digest", "n_posts", rows_per_task)
    return spread_join(posts, parsed, "digest", heavy, ["chat_id", "message_id"])


@built_once
def _post_columns() -> dict[str, Column]:
    sender, phone = F.col("sender"), F.col("phone")
    dealer = D.posted_dealer(F.col("name_in_text"), F.col("dealer"), phone, sender)
    return {"post_dealer": dealer, "post_phone": D.posted_phone(phone, sender)}


def post_rows(templates: DataFrame) -> DataFrame:
    """Give every template row the dealer and phone of the post it came from."""
    return computed_once(templates, **_post_columns()).select(
        F.col("timestamp_ms").alias("ts"), *POST_ORDER,
        *[c for c in INVENTORY_FIELDS if c not in ("dealer", "phone")],
        F.col("post_dealer").alias("dealer"), F.col("post_phone").alias("phone"),
    )


def build_listings(messages: DataFrame, registry: Registry, cache_path: str | None = None) -> DataFrame:
    """The earliest post of every distinct ad, keyed by ``dedup_key``; no duplicate flag yet.

    Dealer and key follow from text and sender, so of equal texts by one
    sender only the earliest post can remain.  They are reduced to it before
    any rule runs, the gate included: each text is read once per sender, and
    nothing has to be joined back.  With ``cache_path`` each text is parsed once in
    all, over all runs.
    """
    if cache_path is not None:
        return keep_earliest(post_rows(extract_once(messages, registry, cache_path)))
    posts = messages.withColumn("digest", digest(F.col("text")))
    first_posts = earliest_per(posts, ["digest", "sender"], ["timestamp_ms", "chat_id", "message_id"])
    parsed = X.parse_texts(dealt(first_posts, "digest", "sender").drop("digest"), registry).withColumn(
        "posted_by", first_filled(F.col("name_in_part"), F.col("name_in_message"))
    )
    return keep_earliest(post_rows(X.to_inventory_rows(parsed, registry)))


def build_inventory(messages: DataFrame, registry: Registry, cache_path: str | None = None) -> DataFrame:
    """The inventory with superseded ads flagged.

    The listings are stored once, since flagging reads them twice.
    """
    return flag_superseded(stored(build_listings(messages, registry, cache_path)))


def batch_inventory(
    messages: DataFrame, registry: Registry, reference_date: dt.date, months: int = 3, keep_run_on: bool = False
) -> DataFrame:
    """Inventory of the recent window by calendar date.

    Reposts take the fields of the latest post and the date of the first;
    the newest ad of a society and dealer is chosen by that date.
    """
    # a range of plain times first, a day wider on both sides: the scan can skip what is outside, whatever the time zone
    day = dt.timedelta(days=1)
    last = dt.datetime.combine(reference_date, dt.time(), dt.timezone.utc)
    year, month = divmod(reference_date.year * 12 + reference_date.month - 1 - months, 12)
    first = dt.datetime(year, month + 1, 1, tzinfo=dt.timezone.utc)
    span = F.col("timestamp_ms").between(int((first - day).timestamp() * 1000), int((last + 2 * day).timestamp() * 1000))
    listings = X.extract_listings(messages.filter(span), registry, count_posts=False)
    merged = consolidate(recent_listings(listings, reference_date, months))
    rows = X.to_inventory_rows(merged, registry, keep_run_on)
    # the phone is looked for once more, now that the dealer stands in for the poster
    resolved = rows.withColumn("phone", D.listing_phone(F.col("contact_no"), F.col("dealer"))).select(
        "dedup_key", "first_post", "times_posted", *INVENTORY_FIELDS
    )
    return flag_superseded(stored(resolved), by=("first_post",))


def run_counters(messages: DataFrame, registry: Registry) -> DataFrame:
    """Messages processed, listings extracted, texts parsed and texts reused."""
    texts = dealt(distinct_texts(messages), "digest").select("text", "n_posts")
    rows = X.templates(texts, registry, keep_empty=True)
    first_row = F.coalesce(F.col("part_no"), F.lit(0)) == 0
    posts = F.col("n_posts")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return rows.agg(
        total(F.when(first_row, posts)).alias("processed"),
        total(F.when(F.col("full_message").isNotNull(), posts)).alias("extracted"),
        total(F.when(first_row, F.lit(1))).alias("parsed"),
        total(F.when(first_row, posts - 1)).alias("reused"),
    )
