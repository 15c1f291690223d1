"""Text rules on whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

import brickledger as b
from brickledger.functions import text as T
from brickledger.functions.strings import fmt_number, fmt_rent, safe_take
from brickledger.operators.ranking import running_number
from brickledger.plans.extraction import repost_key
from brickledger.plans.inventory import distinct_texts
from brickledger.sinks.inventory_csv import csv_cell, file_name, single_line

from .inputs import table
from .registry import check

NOISE = r"^\s*(<media omitted>|this message was deleted|null|ok(ay)?|thanks?|done|yes|no|noted|[^A-Za-z0-9_]*)\s*$"


@check("t1_fold_text", "SELECT doc_id, sha256(replace(replace(text, chr(13), ''), chr(8206), '')) AS folded FROM documents")
def t1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.fold_text(F.col("text")), 256).alias("folded"))


@check("t2_strip_format", r"""
    SELECT page_id, sha256(regexp_replace(regexp_replace(html, '[*_~`]', '', 'g'), '[\p{So}←-⇿⌀-➿⬀-⯿•■-◿]', ' ', 'g')) AS plain
    FROM pages""")
def t2(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(T.strip_format(F.col("html")), 256).alias("plain"))


@check("t3_is_noise", f"""
    SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true
      WHEN 4 THEN false WHEN 5 THEN true ELSE true END AS noise FROM orders""")
def t3(spark, sf):
    key = F.col("o_orderkey")
    text = F.element_at(F.array(
        F.lit(" OK "), F.lit("Thanks"), F.concat(F.lit("ok "), F.col("o_orderpriority")), F.lit("<Media omitted>"),
        F.col("o_orderpriority"), F.lit("?!.. "), F.concat(F.lit("photo <media OMITTED> "), F.lit("")),
    ), (key % 7 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", T.is_noise(text).alias("noise"))


@check("t3_noise_in_documents", f"""
    SELECT doc_id, regexp_matches(text, '(?i){NOISE}') OR trim(text) = '' AS noise FROM documents""")
def t3_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.is_noise(F.col("text")).alias("noise"))


@check("t4_has_listing", f"""
    SELECT p_partkey, p_partkey % 6 NOT IN (4, 5) AS listing FROM part""")
def t4(spark, sf):
    size = (F.col("p_size") + 60).cast("string")
    text = F.element_at(F.array(
        F.concat(size, F.lit(" sq. yds, ")), F.concat(F.lit("3 Bedroom "), F.col("p_name")), F.concat(size, F.lit(" Crore")),
        F.concat(F.lit("PLOT "), F.col("p_name")), F.col("p_name"), F.concat(size, F.lit(" units of "), F.col("p_name")),
    ), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.has_listing(text).alias("listing"))


# prices have two decimals; halves are rounded up
HUNDREDTHS = "regexp_replace((h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0'), '\\.?0+$', '')"


@check("t20_number_formats", f"""
    SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS number, {HUNDREDTHS} || unit AS rent
    FROM (SELECT *, CASE WHEN cents >= 10000000 THEN (cents + 50000) // 100000 ELSE (cents + 500) // 1000 END AS h,
        CASE WHEN cents >= 10000000 THEN ' L' ELSE ' k' END AS unit
      FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem))""")
def t20(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", fmt_number(F.col("l_quantity")).alias("number"),
        fmt_rent(F.col("l_extendedprice")).alias("rent"),
    )


@check("t21_safe_take", "SELECT doc_id, substr(text, 1, 2000) AS head FROM documents")
def t21(spark, sf):
    return table(spark, sf, "documents").select("doc_id", safe_take(F.col("text"), 2000).alias("head"))


@check("d1_text_key", r"""
    SELECT doc_id, sha256(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS key FROM documents""")
def d1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(b.text_key(F.col("text")), 256).alias("key"))


@check("d6_running_count_of_copies", r"""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY regexp_replace(lower(regexp_replace(text, '[*_~`]', '', 'g')),
      '[^0-9a-z_À-ÿ]+', '', 'g') ORDER BY doc_id % 8, doc_id) AS INTEGER) AS times_posted FROM documents""")
def d6(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 8).alias("chat_id"), "text")
    return running_number(docs, F.md5(repost_key(F.col("text"))), "chat_id", "doc_id", "times_posted").select(
        "doc_id", "times_posted"
    )


@check("d7_distinct_texts", "SELECT sha256(text) AS digest, count(*) AS n_posts FROM documents GROUP BY 1")
def d7(spark, sf):
    return distinct_texts(table(spark, sf, "documents").select("text")).select("digest", "n_posts")


@check("k2_csv_cell", r"""
    SELECT page_id, CASE WHEN regexp_matches(t, '[",\r\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS cell
    FROM (SELECT page_id, CASE WHEN regexp_matches(x, '^\s*[=+\-@]') THEN '''' || x ELSE x END AS t
      FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '=' || url ELSE html END AS x FROM pages))""")
def k2(spark, sf):
    kind = F.col("page_id") % 3
    text = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat(F.lit("="), F.col("url"))).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", csv_cell(text).alias("cell"))


@check("k3_single_line", r"""
    SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s*[\r\n]+\s*', ' | ', 'g'), '[ \t]{2,}', ' ', 'g')) AS line
    FROM documents""")
def k3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", single_line(F.col("text")).alias("line"))


@check("k4_file_name", r"""
    SELECT p_partkey, 'Inventory_' || trim(regexp_replace(p_brand || ' & ' || p_name || ' #', '[^A-Za-z0-9_]+', '_', 'g'), '_')
      || '_3m.csv' AS file_name FROM part""")
def k4(spark, sf):
    name = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" & "), F.col("p_name"), F.lit(" #"))
    return table(spark, sf, "part").select("p_partkey", file_name(name, 3).alias("file_name"))
