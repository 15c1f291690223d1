"""Dealers, registry and inventory columns of ads in many shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

import brickledger as b
from brickledger.functions import rows as R
from brickledger.functions.dealer import (
    format_dealer_name, posted_dealer, posted_phone, valid_dealer_name, with_dealer_name,
)
from brickledger.plans.inventory import post_rows
from brickledger.plans.extraction import templates

from .inputs import ads, ads_with, messages, table
from .registry import check

REGISTRY = b.Registry()

NAME_TEXT = """CASE ok % 8
  WHEN 0 THEN rooms || ' BHK' || chr(10) || 'Regards: ' || name || ', ' || mobile
  WHEN 1 THEN rooms || ' BHK 2 cr' || chr(10) || name || ' ' || mobile
  WHEN 2 THEN rooms || ' BHK' || chr(10) || '*' || upper(name) || '*' || chr(10) || '*' || mobile || '*'
  WHEN 3 THEN 'flat for sale' || chr(10) || mobile || ' ' || lower(name)
  WHEN 4 THEN rooms || ' BHK' || chr(10) || 'Golden key realtors' || chr(10) || 'best deal'
  WHEN 5 THEN 'Ready to move flat, call: ' || mobile
  WHEN 6 THEN rooms || ' BHK available for sale in tower ' || name || ' - ' || mobile
  ELSE rooms || ' BHK' || chr(10) || name || chr(10) || 'price 2 cr' || chr(10) || mobile END"""
NAME_FOUND = "CASE WHEN ok % 8 = 4 THEN 'Golden Key Realtors' WHEN ok % 8 = 5 THEN '' ELSE name END"


@check("t17_dealer_name", f"{ads_with(NAME_TEXT)} SELECT message_id, {NAME_FOUND} AS dealer FROM ads")
def t17(spark, sf):
    return with_dealer_name(ads(spark, sf, NAME_TEXT), "text", "dealer", REGISTRY).select("message_id", "dealer")


@check("t18_valid_dealer_name", """
    SELECT o_orderkey, o_orderkey % 8 IN (0, 4, 6) AS valid FROM orders""")
def t18(spark, sf):
    name = F.element_at(F.array(
        F.lit("Asha Verma"), F.concat(F.lit("Asha "), F.col("o_custkey").cast("string")), F.lit("M3M Crown"), F.lit("Urgent Sale"),
        F.lit("Palm Realtech Properties"), F.lit("Sobha City"), F.lit("*José Álvarez*"), F.lit("A."),
    ), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", valid_dealer_name(name, REGISTRY).alias("valid"))


@check("t19_format_dealer_name", """
    SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])),
      'string_agg', ' ') || ' & Sons and Co' AS name FROM part""")
def t19(spark, sf):
    raw = F.concat(F.lit(' *"'), F.upper("p_name"), F.lit('"*   & SONS  And co'))
    return table(spark, sf, "part").select("p_partkey", format_dealer_name(raw).alias("name"))


@check("r2_normalize_project_name", """
    SELECT o_orderkey, ['SMARTWORLD DXP ', 'PURI DIPLOMATIC RESIDENCES ', 'EMERALD AND CO ', 'ATS TRIUMPH '][o_orderkey % 4 + 1]
      || o_custkey AS name FROM orders""")
def r2(spark, sf):
    name = F.element_at(F.array(
        F.lit("Smart   World dxp,"), F.lit("Purí Diplomactic-Residences"), F.lit("Emrald &#38; C&#x6f;"), F.lit("«ats» TRIMPH"),
    ), (F.col("o_orderkey") % 4 + 1).cast("int"))
    full = F.concat(name, F.lit(" - "), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", b.normalize_project_name(full).alias("name"))


@check("r3_project_in_text", f"{ads_with()} SELECT message_id, project FROM ads")
def r3(spark, sf):
    return ads(spark, sf).select("message_id", REGISTRY.canonical_in_text(F.col("text")).alias("project"))


@check("r4_project_of_name", f"""{ads_with()}
    SELECT message_id, project, project <> '' AS selected FROM ads""")
def r4(spark, sf):
    name = F.concat(F.lit("«"), F.col("title"), F.lit("» sec "), F.col("sector"))
    return ads(spark, sf).select(
        "message_id", REGISTRY.canonical_name(name).alias("project"), REGISTRY.is_selected(name).alias("selected")
    )


CUSTOM = REGISTRY.add("Maple Residency").add("Lake Orchid", ["Orchid  Residency"])


@check("r5_custom_projects", f"""{ads_with()}
    SELECT message_id, CASE ck % 6 WHEN 4 THEN 'MAPLE RESIDENCY' WHEN 5 THEN 'LAKE ORCHID' ELSE project END AS in_text,
      CASE ck % 6 WHEN 4 THEN 'MAPLE RESIDENCY' WHEN 5 THEN 'LAKE ORCHID' ELSE project END AS of_name FROM ads""")
def r5(spark, sf):
    return ads(spark, sf).select(
        "message_id", CUSTOM.canonical_in_text(F.col("text")).alias("in_text"),
        CUSTOM.canonical_name(F.col("title")).alias("of_name"),
    )


FIELD_TEXT = """CASE ok % 6
  WHEN 0 THEN 'Unit no ' || area || ' tower ' || rooms || 'b, ground floor with maid room'
  WHEN 1 THEN 'Tower-' || rooms || chr(10) || whole || 'th floor and study'
  WHEN 2 THEN 'flat ' || area || '/a on UGF'
  WHEN 3 THEN 'block ' || rooms || 'c floor - ' || whole || ' servant, study'
  WHEN 4 THEN 'Sector-' || sector || chr(10) || 'DLF plot'
  ELSE 'sec ' || sector || ' b near @ 1' || area || '/-' END"""


@check("i1_i5_inventory_fields", f"""{ads_with(FIELD_TEXT)}
    SELECT message_id,
      CASE ok % 6 WHEN 4 THEN sector WHEN 5 THEN sector || 'B' ELSE '' END AS sec, area,
      rooms || 'BHK' || CASE ok % 6 WHEN 0 THEN ' + SR' WHEN 1 THEN ' + STUDY' WHEN 3 THEN ' + SR + STUDY' ELSE '' END AS acco,
      CASE ok % 6 WHEN 0 THEN 'PLOT' WHEN 2 THEN 'SHOP' ELSE 'OFFICE' END AS kind_acco,
      CASE ok % 6 WHEN 0 THEN 'GROUND' WHEN 1 THEN CAST(whole AS VARCHAR) WHEN 2 THEN 'UGF' WHEN 3 THEN CAST(whole AS VARCHAR)
        ELSE 'SCO' END AS floor,
      CASE ok % 6 WHEN 0 THEN 'T ' || rooms || 'B ' || area WHEN 1 THEN 'T ' || rooms WHEN 2 THEN area || '/A'
        WHEN 3 THEN 'BLOCK ' || rooms || 'C' ELSE '' END AS flat_no,
      CASE ok % 6 WHEN 0 THEN whole || ' CR | 3 CR' WHEN 1 THEN '45 k' WHEN 5 THEN '@ 1' || area ELSE '' END AS price
    FROM ads""")
def i1(spark, sf):
    text, shape = F.col("text"), F.col("ok") % 6
    kind = F.when(shape == 0, "Plot / Land").when(shape == 2, "Shop / Retail").otherwise("SCO / Plot (Commercial)")
    sale = F.when(shape == 0, F.concat(F.col("whole").cast("string"), F.lit(" | 3"))).otherwise("")
    rent = F.when(shape == 1, "45 k").otherwise("")
    return ads(spark, sf, FIELD_TEXT).select(
        "message_id", R.sector_number(F.lit(""), text).alias("sec"),
        R.area_number(F.concat(F.col("area"), F.lit(" sq.ft | 9 sq.yd"))).alias("area"),
        R.accommodation(F.col("rooms"), F.lit(""), text).alias("acco"),
        R.accommodation(F.lit(""), kind, text).alias("kind_acco"),
        R.floor_label(kind, text).alias("floor"), R.flat_number(text).alias("flat_no"),
        R.price_label(sale, rent, F.lit(""), text).alias("price"),
    )


@check("i7_i8_listing_rows", f"""{ads_with(NAME_TEXT)}
    SELECT message_id, CASE WHEN {NAME_FOUND} = '' THEN sender ELSE {NAME_FOUND} END AS dealer,
      CASE WHEN ok % 8 = 4 THEN '' ELSE mobile END AS phone FROM ads WHERE ok % 8 NOT IN (3, 5)""")
def i7(spark, sf):
    rows = b.to_inventory_rows(b.extract_listings(messages(spark, sf, NAME_TEXT), REGISTRY, count_posts=False), REGISTRY)
    return rows.select("message_id", "dealer", "phone")


SENDER_SQL = """CASE ck % 4 WHEN 0 THEN CAST(70000000000000 + ck AS STRING) || '@lid' WHEN 1 THEN 'Kiran ' || CAST(ck AS STRING)
  WHEN 2 THEN CAST(919000000000 + ck AS STRING) || '@s.whatsapp.net' ELSE CAST(8000000000000 + ck AS STRING) END"""
BARE_TEXT = "title || chr(10) || rooms || ' BHK' || chr(10) || area || ' sqft'"


@check("i9_posted_dealer", f"""{ads_with(BARE_TEXT)}
    SELECT message_id,
      CASE ck % 4 WHEN 0 THEN right(CAST(70000000000000 + ck AS VARCHAR), 10) WHEN 1 THEN 'Kiran ' || ck
        WHEN 2 THEN CAST(919000000000 + ck AS VARCHAR) ELSE right(CAST(8000000000000 + ck AS VARCHAR), 10) END AS dealer,
      CASE ck % 4 WHEN 0 THEN right(CAST(70000000000000 + ck AS VARCHAR), 10) WHEN 1 THEN ''
        WHEN 2 THEN CAST(9000000000 + ck AS VARCHAR) ELSE right(CAST(8000000000000 + ck AS VARCHAR), 10) END AS phone
    FROM ads""")
def i9(spark, sf):
    posts = ads(spark, sf, BARE_TEXT).withColumn("sender", F.expr(SENDER_SQL)).select(
        "chat_id", "message_id", "timestamp_ms", "sender", "text"
    )
    return post_rows(templates(posts, REGISTRY)).select("message_id", "dealer", "phone")


@check("i9_dealer_precedence", f"""{ads_with()}
    SELECT message_id, CASE ok % 5 WHEN 0 THEN name WHEN 1 THEN 'Tara Rao' WHEN 2 THEN sender WHEN 3 THEN mobile ELSE 'Dealer' END
      AS dealer, CASE ok % 5 WHEN 4 THEN '' WHEN 2 THEN right(sender, 10) ELSE mobile END AS phone FROM ads""")
def i9_precedence(spark, sf):
    shape = F.col("ok") % 5
    in_text = F.when(shape == 0, F.col("name")).otherwise("")
    template = F.when(shape == 1, "Tara Rao").otherwise(F.when(shape == 2, "dealer").otherwise(""))
    sender = F.when(shape == 3, "70000000000000@lid").when(shape == 4, "abc@lid").otherwise(F.col("sender"))
    phone = F.when(shape.isin(2, 4), "").otherwise(F.col("mobile"))
    return ads(spark, sf).select(
        "message_id", posted_dealer(in_text, template, phone, sender).alias("dealer"), posted_phone(phone, sender).alias("phone")
    )
