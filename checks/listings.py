"""Fields of listings: expected values by arithmetic on the columns the ads were made from."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

import brickledger as b
from brickledger.functions import text as T
from brickledger.functions.money import money
from brickledger.functions.project import project

from .inputs import PRICE, RENT_TEXT, SALE_TEXT, SOCIETY, ads, ads_with, messages, table
from .registry import check

REGISTRY = b.Registry()
TWO_ADS = f"{SALE_TEXT} || chr(10) || chr(10) || {RENT_TEXT}"
RENT_DAY = "strftime(make_timestamp(timestamp_ms * 1000), '%d/%m/%y')"

# an ad of every kind, from the same fields
KINDS_TEXT = """CASE ok % 8
  WHEN 0 THEN 'Shop in ' || title || chr(10) || area || ' sq ft lease'
  WHEN 1 THEN 'SCO ' || title || chr(10) || 'wanted urgently, ' || area || ' sqyd'
  WHEN 2 THEN 'Office space' || chr(10) || area || ' sq.ft on rent or resale'
  WHEN 3 THEN 'Farm house kothi' || chr(10) || area || ' gaj' || chr(10) || 'price on request'
  WHEN 4 THEN 'Builder Floor' || chr(10) || area || ' sq yards inventory'
  WHEN 5 THEN 'Need plot' || chr(10) || area || ' sqyd available'
  WHEN 6 THEN 'Studio ' || title || chr(10) || area || ' sqft required'
  ELSE area || ' sqft ' || chr(10) || whole || ' acre' END"""

MONEY_TEXT = """CASE ok % 8
  WHEN 0 THEN 'Rent ' || whole || '.5 lac' || chr(10) || 'asking ' || whole || ' Cr'
  WHEN 1 THEN 'Price 2.' || part || ' lac Sq.yd slightly'
  WHEN 2 THEN 'Rent ' || part || 'k, our demand ' || part || '.25 lakhs'
  WHEN 3 THEN 'monthly 4' || part || ',000 + maintenance'
  WHEN 4 THEN 'cost ' || part || ' lacs, ' || whole || ',5 crores'
  WHEN 5 THEN 'Plot 200 sqyd @ ' || part || ' k'
  WHEN 6 THEN whole || '.80L + M'
  ELSE 'lease 1' || area || ' sqft' || chr(10) || whole || ' cr per sqft' END"""


@check("t5_chunks", f"""{ads_with(TWO_ADS)}
    SELECT message_id, 0 AS part_no, {SALE_TEXT} AS piece FROM ads UNION ALL SELECT message_id, 1, {RENT_TEXT} FROM ads""")
def t5(spark, sf):
    return ads(spark, sf, TWO_ADS).select("message_id", F.posexplode(T.chunks(F.col("text"))).alias("part_no", "piece"))


@check("t6_deal_type", f"""{ads_with(KINDS_TEXT)}
    SELECT message_id, ['Rent', 'Requirement', 'Sale / Rent', 'Sale', 'Other', 'Requirement', 'Requirement', 'Other'][ok % 8 + 1]
      AS deal FROM (SELECT message_id, ok FROM ads WHERE ok % 8 <> 5)
    UNION ALL SELECT message_id, 'Requirement' FROM ads WHERE ok % 8 = 5""")
def t6(spark, sf):
    return ads(spark, sf, KINDS_TEXT).select("message_id", T.deal_type(F.col("text")).alias("deal"))


@check("t7_property_type", f"""{ads_with(KINDS_TEXT)}
    SELECT message_id, ['Shop / Retail', 'SCO / Plot (Commercial)', 'Office / Commercial', 'Villa / Bungalow',
      'Independent / Builder Floor', 'Plot / Land', 'Apartment / Flat', 'Plot / Land'][ok % 8 + 1] AS kind FROM ads""")
def t7(spark, sf):
    return ads(spark, sf, KINDS_TEXT).select("message_id", T.property_type(F.col("text")).alias("kind"))


@check("t8_bhk", f"{ads_with(TWO_ADS)} SELECT message_id, rooms AS bhk FROM ads")
def t8(spark, sf):
    return ads(spark, sf, TWO_ADS).select("message_id", T.bhk_label(T.bhk(F.col("text"))).alias("bhk"))


@check("t8_bhk_lists", """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '2/2.5/4' WHEN 1 THEN '1/3' ELSE CAST(1 + o_custkey % 9 AS VARCHAR) END
      AS bhk FROM orders""")
def t8_lists(spark, sf):
    text = F.element_at(F.array(
        F.lit("4 , 2.5 & 2 bhk, 4 BHK"), F.lit("3+1 bhk"),
        F.concat((1 + F.col("o_custkey") % 9).cast("string"), F.lit(" Bed Room")),
    ), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", T.bhk_label(T.bhk(text)).alias("bhk"))


@check("t9_sizes", f"""{ads_with(KINDS_TEXT)}
    SELECT message_id, area || CASE WHEN ok % 8 IN (1, 3, 4, 5) THEN ' sq.yd' ELSE ' sq.ft' END AS sizes FROM ads""")
def t9(spark, sf):
    return ads(spark, sf, KINDS_TEXT).select("message_id", F.array_join(T.sizes(F.col("text")), "|").alias("sizes"))


MONEY_FRACTION = "rtrim(CAST(part AS VARCHAR), '0')"


@check("t10_money", f"""{ads_with(MONEY_TEXT)}
    SELECT message_id,
      CASE ok % 8 WHEN 0 THEN whole * 100 WHEN 2 THEN part WHEN 4 THEN whole * 100 + 50 + part ELSE 0 END AS sale_lakh,
      CASE ok % 8 WHEN 0 THEN whole * 100000 + 50000 WHEN 2 THEN part * 1000 WHEN 3 THEN 400000 + part * 1000
        WHEN 6 THEN whole * 100000 + 80000 ELSE 0 END AS rent_inr,
      CASE ok % 8 WHEN 1 THEN '2.' || {MONEY_FRACTION} || ' L/unit' WHEN 5 THEN CAST(part AS VARCHAR) || ' K/unit'
        WHEN 7 THEN whole || ' Cr/unit' ELSE '' END AS rates
    FROM ads""")
def t10(spark, sf):
    def total(values, factor):
        return F.floor(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * factor) + F.lit(0.001))

    found = ads(spark, sf, MONEY_TEXT).select("message_id", money(F.col("text"), F.lit("Sale")).alias("m"))
    return found.select(
        "message_id", total(F.col("m.sale"), 100.0).alias("sale_lakh"), total(F.col("m.rent"), 1.0).alias("rent_inr"),
        F.array_join("m.rates", "|").alias("rates"),
    )


RATE_TEXT = """CASE ok % 3 WHEN 0 THEN area || ' per sqft, then 1' || area || '/- per sq ft'
  WHEN 1 THEN 'Book 10300/- @ 1' || area || '/ all in' ELSE '@ ' || area || '.5 only' END"""


@check("t11_rate", f"""{ads_with(RATE_TEXT)}
    SELECT message_id, CASE ok % 3 WHEN 0 THEN CASE WHEN CAST(area AS INT) >= 1000 THEN area ELSE '1' || area END
      WHEN 1 THEN '@ 1' || area ELSE '' END AS rate FROM ads""")
def t11(spark, sf):
    return ads(spark, sf, RATE_TEXT).select("message_id", T.rate_psf(F.col("text")).alias("rate"))


PLACE_TEXT = """'Sec-' || sector || ' and sector ' || sector || 'b, sec 7, near ' ||
  CASE ok % 3 WHEN 0 THEN 'GOLF  course road' WHEN 1 THEN 'old market' ELSE 'Sohna' || chr(10) || 'road' END"""


@check("t12_location", f"""{ads_with(PLACE_TEXT)}
    SELECT message_id, 'Sector ' || sector || ', Sector ' || sector || 'B' ||
      CASE ok % 3 WHEN 0 THEN ', Golf Course Road' WHEN 1 THEN '' ELSE ', Sohna Road' END AS location FROM ads""")
def t12(spark, sf):
    return ads(spark, sf, PLACE_TEXT).select("message_id", T.location(F.col("text")).alias("location"))


PHONE_TEXT = "'call +91-' || left(mobile, 5) || ' ' || right(mobile, 5) || ' or ' || CAST(8000000000 + ck AS STRING) || ', 5' || mobile"


@check("t13_phones", f"""{ads_with(PHONE_TEXT)}
    SELECT message_id, mobile || ',' || CAST(8000000000 + ck AS VARCHAR) AS phones FROM ads""")
def t13(spark, sf):
    return ads(spark, sf, PHONE_TEXT).select("message_id", F.array_join(T.phones(F.col("text")), ",").alias("phones"))


@check("t14_project", f"{ads_with()} SELECT message_id, {SOCIETY} AS project FROM ads")
def t14(spark, sf):
    return ads(spark, sf).select("message_id", project(F.col("text"), REGISTRY).alias("project"))


TITLE_TEXT = """CASE ok % 4
  WHEN 0 THEN 'Nice house in Palladian ' || rooms || 'x Gardens, sector ' || sector || chr(10) || area || ' sqft'
  WHEN 1 THEN 'Price on call' || chr(10) || 'Emerald Heights Block ' || sector || chr(10) || mobile
  WHEN 2 THEN 'Project: Hill View ' || sector || ' size ' || area
  ELSE '*New launch*' || chr(10) || 'Location - Lake Enclave ' || sector || chr(10) || 'Tower 5' END"""


@check("t16_project_titles", f"""{ads_with(TITLE_TEXT)}
    SELECT message_id, CASE ok % 4 WHEN 0 THEN 'Palladian ' || rooms || 'x Gardens' WHEN 1 THEN 'Emerald Heights Block ' || sector
      WHEN 2 THEN 'Hill View ' || sector ELSE 'Lake Enclave ' || sector END AS project FROM ads""")
def t16(spark, sf):
    return ads(spark, sf, TITLE_TEXT).select("message_id", project(F.col("text"), REGISTRY).alias("project"))


LISTING_COLUMNS = [
    "message_id", "part_no", "date", "time", "posted_by", "deal_type", "property_type", "project_or_society", "location", "bhk",
    "size", "sale_price_cr", "rent_per_month", "rate_per_sqft", "contact_no", "listing_in_msg", "times_posted", "full_message",
]


@check("t22_extract_listings", f"""{ads_with(TWO_ADS)},
    counted AS (SELECT *, CAST(row_number() OVER (PARTITION BY ck, rooms ORDER BY chat_id, message_id) AS INTEGER) AS nth
      FROM ads)
    SELECT message_id, 0 AS part_no, {RENT_DAY} AS date, '00:00' AS time, name AS posted_by, 'Sale' AS deal_type,
      'Apartment / Flat' AS property_type, {SOCIETY} AS project_or_society, 'Sector ' || sector AS location, rooms AS bhk,
      area || ' sq.ft' AS size, {PRICE} AS sale_price_cr, '' AS rent_per_month, '' AS rate_per_sqft, mobile AS contact_no,
      '1 of 2' AS listing_in_msg, nth AS times_posted, {SALE_TEXT} AS full_message FROM counted
    UNION ALL
    SELECT message_id, 1, {RENT_DAY}, '00:00', name, 'Rent', 'Apartment / Flat', 'Orchid Residency', 'Sector ' || sector,
      rooms, '', '', CAST(15 + ck % 80 AS VARCHAR) || ' k', '', mobile, '2 of 2', nth, {RENT_TEXT} FROM counted""")
def t22(spark, sf):
    return b.extract_listings(messages(spark, sf, TWO_ADS), REGISTRY).select(*LISTING_COLUMNS)


@check("d6_times_posted", f"""{ads_with()}
    SELECT message_id, CAST(row_number() OVER (PARTITION BY ck, rooms ORDER BY chat_id, message_id) AS INTEGER) AS times_posted
    FROM ads""")
def d6(spark, sf):
    return b.extract_listings(messages(spark, sf), REGISTRY).select("message_id", "times_posted")


@check("c10_window_cutoff", """
    SELECT o_orderkey, epoch_ms(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH) AS one_month,
      epoch_ms(date_trunc('month', o_orderdate) - INTERVAL 3 MONTH) AS three_months FROM orders""")
def c10(spark, sf):
    return ads(spark, sf).select(
        F.col("ok").alias("o_orderkey"), b.window_cutoff(F.col("timestamp_ms"), 1).alias("one_month"),
        b.window_cutoff(F.col("timestamp_ms"), 3).alias("three_months"),
    )


@check("c11_recent_listings", f"""{ads_with()}
    SELECT message_id, {RENT_DAY} AS date FROM ads
    WHERE make_timestamp(timestamp_ms * 1000) BETWEEN TIMESTAMP '2000-11-01' AND TIMESTAMP '2001-02-14'""")
def c11(spark, sf):
    dated = ads(spark, sf).select("message_id", F.date_format(F.timestamp_millis("timestamp_ms"), "dd/MM/yy").alias("date"))
    return b.recent_listings(dated, dt.date(2001, 2, 14))
