"""Time windows of the inventory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import parsed_date


def latest_timestamp(message: DataFrame) -> DataFrame:
    """Time of the message with the highest id, which need not be the latest time."""
    return message.agg(F.max_by("timestamp", "_id").alias("latest_timestamp_ms"))


def window_cutoff(ts_ms: Column, months: int) -> Column:
    """Epoch milliseconds of the first day of the month ``months`` before ``ts_ms``."""
    day = F.to_date(F.timestamp_millis(ts_ms))
    return F.unix_millis(F.date_trunc("month", F.add_months(day, -months)))


def recent_listings(listings: DataFrame, reference_date: dt.date, months: int = 3) -> DataFrame:
    """Listings dated from the first day of the window up to ``reference_date``, both included."""
    last = F.lit(reference_date)
    first = F.trunc(F.add_months(last, -months), "month")
    return listings.filter(parsed_date(F.col("date")).between(first, last))
