"""Deduplication, inventories, summaries, files and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

import brickledger as b
from brickledger.functions.patterns import BYTE_ORDER_MARK
from brickledger.operators.ranking import numbered
from brickledger.operators.storage import new_path
from brickledger.schemas import INVENTORY_FIELDS
from brickledger.sinks.inventory_csv import file_name, inventory_lines

from .inputs import KEPT_WITH, SALE_TEXT, ads_sql, ads_with, messages
from .listings import TWO_ADS
from .registry import check

REGISTRY = b.Registry()
FIELDS = ", ".join(INVENTORY_FIELDS)


def listings(spark, sf):
    return b.build_listings(messages(spark, sf), REGISTRY)


def inventory(spark, sf):
    return b.build_inventory(messages(spark, sf), REGISTRY)


@check("d2_keep_earliest", f"{KEPT_WITH} SELECT dedup_key, ts, chat_id, message_id, part_no, {FIELDS} FROM kept")
def d2(spark, sf):
    return listings(spark, sf).select("dedup_key", "ts", "chat_id", "message_id", "part_no", *INVENTORY_FIELDS)


# Two-digit years are read as 2000 to 2099, so dates before 2000 come a century later.
CONSOLIDATED = f"""{ads_with()},
dated AS (SELECT *, (timestamp_ms + CASE WHEN timestamp_ms < 946684800000 THEN 3155760000000 ELSE 0 END)::HUGEINT
  * 1000000000000 + chat_id * 10000000000 + message_id AS moment FROM ads),
grouped AS (SELECT ck, rooms, name, text, mobile, count(*) AS n, arg_min(timestamp_ms, moment) AS first_ms,
    arg_max(message_id, moment) AS latest, min(moment) AS first_moment
  FROM dated GROUP BY ALL)"""


@check("d3_consolidate", f"""{CONSOLIDATED}
    SELECT latest AS message_id, strftime(make_timestamp(first_ms * 1000), '%d/%m/%y') AS date,
      CAST(n AS INTEGER) AS times_posted, name AS posted_by FROM grouped""")
def d3(spark, sf):
    extracted = b.extract_listings(messages(spark, sf), REGISTRY, count_posts=False)
    return b.consolidate(extracted).select("message_id", "date", "times_posted", "posted_by")


@check("d4_flag_superseded", f"{KEPT_WITH} SELECT dedup_key, society, dealer, is_duplicate FROM flagged")
def d4(spark, sf):
    return inventory(spark, sf).select("dedup_key", "society", "dealer", "is_duplicate")


@check("d7_extract_once", f"""{ads_with()}
    SELECT message_id, 0 AS part_no, sha256(text) AS digest, name AS dealer, mobile AS phone, area FROM ads""")
def d7(spark, sf):
    return b.extract_once(messages(spark, sf), REGISTRY).select("message_id", "part_no", "digest", "dealer", "phone", "area")


@check("d7_parse_cache_reuse", f"{KEPT_WITH} SELECT dedup_key, ts, message_id, society, dealer, phone FROM kept")
def d7_cache(spark, sf):
    cache = new_path(spark, "cache") + "/parsed"
    posts = messages(spark, sf)
    # the first run knows half of the texts, the second meets all of them
    b.extract_once(posts.filter(F.col("message_id") % 2 == 0), REGISTRY, cache)
    rows = b.build_listings(posts, REGISTRY, cache)
    return rows.select("dedup_key", "ts", "message_id", "society", "dealer", "phone")


@check("i12_batch_inventory", f"""{CONSOLIDATED.replace("FROM dated GROUP", "FROM dated WHERE make_timestamp(timestamp_ms * 1000) BETWEEN TIMESTAMP '2000-06-01' AND TIMESTAMP '2001-06-15' GROUP")},
    rows AS (SELECT g.*, a.project, a.title, a.sector, a.area FROM grouped g JOIN ads a ON a.message_id = g.latest),
    named AS (SELECT *, CASE WHEN project = '' THEN title || ' Sector ' || sector ELSE project END AS society FROM rows)
    SELECT society, CASE WHEN project = '' THEN 'OUT' ELSE 'IN' END AS status, sector AS sec, area, name AS dealer, mobile AS phone,
      CAST(n AS INTEGER) AS times_posted, row_number() OVER (PARTITION BY society, name
        ORDER BY first_moment DESC) <> 1 AS is_duplicate
    FROM named""")
def i12(spark, sf):
    rows = b.batch_inventory(messages(spark, sf), REGISTRY, dt.date(2001, 6, 15), months=12)
    return rows.select("society", "status", "sec", "area", "dealer", "phone", "times_posted", "is_duplicate")


@check("i13_build_inventory", f"{KEPT_WITH} SELECT ts, chat_id, message_id, {FIELDS}, is_duplicate FROM flagged")
def i13(spark, sf):
    return inventory(spark, sf).select("ts", "chat_id", "message_id", *INVENTORY_FIELDS, "is_duplicate")


@check("a1_totals", f"{KEPT_WITH} SELECT count(*) AS total_rows, sum(CASE WHEN status = 'IN' THEN 1 ELSE 0 END) AS matched FROM kept")
def a1(spark, sf):
    return b.totals(listings(spark, sf))


SUMMARY = "count(*) AS total_listings, count(DISTINCT dealer) AS unique_dealers, max(ts) AS latest_timestamp"


@check("a2_project_summaries", f"{KEPT_WITH} SELECT society, status, {SUMMARY} FROM kept GROUP BY society, status")
def a2(spark, sf):
    return b.project_summaries(listings(spark, sf))


CURATED = f"""{KEPT_WITH}, names AS (SELECT * FROM (VALUES {", ".join(
    f"({i}, '{name}')" for i, name in enumerate(REGISTRY.names()))}) AS t(ord, society)),
curated AS (SELECT n.ord, n.society, 'IN' AS status, coalesce(total_listings, 0) AS total_listings,
    coalesce(unique_dealers, 0) AS unique_dealers, coalesce(latest_timestamp, 0) AS latest_timestamp
  FROM names n LEFT JOIN (SELECT society, {SUMMARY} FROM kept WHERE status = 'IN' GROUP BY society) s ON n.society = s.society)"""


@check("a3_curated_summaries", f"{CURATED} SELECT * FROM curated")
def a3(spark, sf):
    return b.curated_summaries(listings(spark, sf), REGISTRY)


@check("a4_out_summaries", f"""{KEPT_WITH}
    SELECT society, 'OUT' AS status, {SUMMARY} FROM kept WHERE status = 'OUT' GROUP BY society""")
def a4(spark, sf):
    return b.out_summaries(listings(spark, sf), REGISTRY)


@check("a5_inventory_kpis", f"""{CURATED}
    SELECT sum(total_listings) AS total_listings, count(*) AS in_projects,
      sum(CASE WHEN total_listings > 0 THEN 1 ELSE 0 END) AS projects_with_stock FROM curated""")
def a5(spark, sf):
    return b.inventory_kpis(b.curated_summaries(listings(spark, sf), REGISTRY))


@check("a6_run_counters", f"""{ads_with(TWO_ADS)}
    SELECT count(*) AS processed, 2 * count(*) AS extracted, count(DISTINCT text) AS parsed,
      count(*) - count(DISTINCT text) AS reused FROM ads""")
def a6(spark, sf):
    return b.run_counters(messages(spark, sf, TWO_ADS), REGISTRY)


@check("c12_filter_projects", f"""{KEPT_WITH}
    SELECT society, status, {SUMMARY} FROM kept WHERE society ILIKE '%SECTOR 1%' AND status <> 'IN' GROUP BY society, status""")
def c12(spark, sf):
    return b.filter_projects(b.project_summaries(listings(spark, sf)), " SECTOR 1 ", status="OUT")


@check("c13_filter_curated", f"{CURATED} SELECT * FROM curated WHERE society ILIKE '%m3m%' AND total_listings = 0")
def c13(spark, sf):
    return b.filter_projects(b.curated_summaries(listings(spark, sf), REGISTRY), "m3m", stock="EMPTY")


@check("c14_filter_out_projects", f"""{KEPT_WITH}
    SELECT society, 'OUT' AS status, {SUMMARY} FROM kept WHERE status = 'OUT' AND society ILIKE '% sector 2%' GROUP BY society""")
def c14(spark, sf):
    return b.filter_out_projects(b.out_summaries(listings(spark, sf), REGISTRY), " sector 2")


@check("c15_in_listings", f"""{KEPT_WITH}
    SELECT ts, message_id, society, dealer, price, is_duplicate FROM flagged
    WHERE status = 'IN' AND society = 'SOBHA CITY' AND concat_ws(chr(10), {FIELDS}) ILIKE '%3 bhk%'""")
def c15(spark, sf):
    found = b.in_listings(inventory(spark, sf), search="3 BHK", society=" SOBHA CITY ")
    return found.select("ts", "message_id", "society", "dealer", "price", "is_duplicate")


@check("c15_indexed_listings", f"""{KEPT_WITH}
    SELECT ts, message_id, society, dealer, price, is_duplicate FROM flagged
    WHERE status = 'IN' AND concat_ws(chr(10), {FIELDS}) ILIKE '%icon%sector 1_%menon%'""")
def c15_indexed(spark, sf):
    index = b.index_inventory(inventory(spark, sf), new_path(spark, "index"))
    found = b.in_listings(None, search="ICON%sector 1_%Menon", index=index)
    return found.select("ts", "message_id", "society", "dealer", "price", "is_duplicate")


@check("sql_in_listings", f"""{KEPT_WITH}
    SELECT ts, message_id, society, dealer, price, is_duplicate FROM flagged
    WHERE status = 'IN' AND society = 'SOBHA CITY' AND concat_ws(chr(10), {FIELDS}) ILIKE '%3 bhk%'""")
def sql_in_listings(spark, sf):
    b.register_inventory_functions(inventory(spark, sf), "check_")
    return spark.sql("SELECT ts, message_id, society, dealer, price, is_duplicate FROM check_in_listings('3 BHK', ' SOBHA CITY ')")


@check("c16_rows_for_project", f"""{KEPT_WITH}
    SELECT ts, message_id, dealer, phone, is_duplicate FROM flagged WHERE society = 'M3M CAPITAL'""")
def c16(spark, sf):
    return b.rows_for_project(inventory(spark, sf), "M3M CAPITAL").select("ts", "message_id", "dealer", "phone", "is_duplicate")


LINE = """society || ',' || status || ',' || sec || ',' || area || ',' || acco || ',' || floor || ',' || flat_no || ',' || dealer || ','
  || phone || ',' || price || ',' || replace(full_message, chr(10), ' | ') || ',' || CAST(is_duplicate AS VARCHAR)"""


@check("k1_csv_lines", f"{KEPT_WITH} SELECT ts, message_id, {LINE} AS value FROM flagged")
def k1(spark, sf):
    return inventory_lines(inventory(spark, sf)).select("ts", "message_id", "value")


HEADER = "chr(65279) || 'SOCIETY,PROJECT LIST STATUS,SEC ,AREA ,ACCO,FLOOR,FLAT NO,DEALER NAME ,PHONE NO,PRICE,FULL MESSAGE,is_duplicate'"


def file_lines(spark, path):
    """``(file_name, place, value)`` of the lines below ``path``: place counts through the part files in name order, from 0.

    Lines are read by parts of files and numbered by range, so neither a file
    nor a name needs to fit a task.
    """
    # the reader leaves out the byte order mark of a file, whose three bytes are then missing from the lines
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\r\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    read = lines.groupBy("path", "size").agg(F.min(F.struct("start", "at")).alias("first"), F.sum(F.octet_length("value") + 2).alias("n"))
    marked = read.filter(F.col("size") - F.col("n") == 3).select(F.col("path").alias("_path"), "first")
    first = (F.col("path") == F.col("_path")) & (F.struct("start", "at") == F.col("first"))
    whole = lines.join(marked, first, "left").select(
        F.regexp_extract(F.url_decode("path"), "file_name=([^/]+)/", 1).alias("file_name"), "path", "start", "at",
        F.concat(F.when(F.col("first").isNotNull(), BYTE_ORDER_MARK).otherwise(""), "value").alias("value"))
    placed = numbered(whole, ["file_name"], ["path", "start", "at"], "place")
    return placed.select("file_name", (F.col("place") - 1).cast("int").alias("place"), "value")


@check("k1_csv_file", f"""{KEPT_WITH}
    SELECT 0 AS place, {HEADER} AS value UNION ALL
    SELECT CAST(row_number() OVER (ORDER BY ts, chat_id, message_id) AS INTEGER), {LINE} FROM flagged""")
def k1_file(spark, sf):
    path = new_path(spark, "csv") + "/master"
    b.write_inventory_csv(inventory(spark, sf), path)
    return file_lines(spark, path).select("place", "value")


FILE = "'Inventory_' || trim(regexp_replace(society, '[^A-Za-z0-9_]+', '_', 'g'), '_') || '_1m.csv'"


@check("k5_project_files", f"""{KEPT_WITH}
    SELECT {FILE} AS file_name, CAST(row_number() OVER (PARTITION BY society ORDER BY ts, chat_id, message_id) AS INTEGER) AS place,
      {LINE} AS value FROM flagged
    UNION ALL SELECT DISTINCT {FILE}, 0, {HEADER} FROM flagged""")
def k5(spark, sf):
    path = new_path(spark, "csv") + "/projects"
    b.write_inventory_csv(inventory(spark, sf), path, by_project=True)
    return file_lines(spark, path)


@check("k5_file_name_clashes", f"""{KEPT_WITH},
    named AS (SELECT ts, message_id, ['A-B', 'A B', 'दिल्ली', '東京', 'Plain'][message_id % 5 + 1] AS society FROM flagged)
    SELECT society, 'Inventory_' || CASE message_id % 5 WHEN 0 THEN 'A_B_' WHEN 1 THEN 'A_B_' WHEN 4 THEN 'Plain' ELSE 'Project_' END
        || CASE WHEN message_id % 5 < 4 THEN left(md5(society), 8) ELSE '' END || '_1m.csv' AS file_name, count(*) AS n
    FROM named GROUP BY ALL""")
def k5_clashes(spark, sf):
    path = new_path(spark, "csv") + "/projects"
    names = F.array(*map(F.lit, ["A-B", "A B", "दिल्ली", "東京", "Plain"]))
    rows = inventory(spark, sf).withColumn("society", F.element_at(names, (F.col("message_id") % 5 + 1).cast("int")))
    b.write_inventory_csv(rows, path, by_project=True)
    lines = file_lines(spark, path).filter("place > 0")
    return lines.groupBy(F.substring_index("value", ",", 1).alias("society"), "file_name").agg(F.count("*").alias("n"))


@check("k4_project_file_rows", f"{KEPT_WITH} SELECT {FILE} AS file_name, {LINE} AS value FROM flagged WHERE society = 'GODREJ ICON'")
def k4(spark, sf):
    rows = b.rows_for_project(inventory(spark, sf), "GODREJ ICON")
    return inventory_lines(rows).select(file_name(F.col("society"), 1).alias("file_name"), "value")


BATCHES = 4


def _stream(spark, sf):
    """Ads as a stream of several batches, a file each; posts of one ad come in any order and in different batches."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = new_path(spark, "orders")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    # all rows of a part are in one range, so each folder holds one file; the parts are written side by side
    parts = orders.withColumn("part", F.pmod(F.hash("o_orderkey"), F.lit(BATCHES))).repartitionByRange(BATCHES, "part")
    parts.write.partitionBy("part").parquet(folder)
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream.createOrReplaceTempView("orders")
    return spark.sql(ads_sql("spark", SALE_TEXT)).select("chat_id", "message_id", "timestamp_ms", "sender", "text")


def _streamed(spark, sf):
    folder = new_path(spark, "stream")
    query = b.stream_inventory(_stream(spark, sf), f"{folder}/out", f"{folder}/checkpoint", REGISTRY, f"{folder}/cache")
    query.awaitTermination()
    return folder


@check("w1_earliest_posts_stream", f"{KEPT_WITH} SELECT dedup_key, ts, message_id, society, dealer FROM kept")
def w1(spark, sf):
    folder = new_path(spark, "stream")
    updates = b.earliest_posts_stream(_stream(spark, sf), REGISTRY)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    writer = updates.writeStream.outputMode("update").foreachBatch(write)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    # an ad is written again when its earliest post changes
    rows = spark.read.parquet(f"{folder}/out")
    last = rows.groupBy("dedup_key").agg(F.max_by(F.struct("ts", "message_id", "society", "dealer"), "batch").alias("r"))
    return last.select("dedup_key", "r.*")


@check("w2_stream_inventory", f"{KEPT_WITH} SELECT dedup_key, ts, message_id, society, dealer, is_duplicate FROM flagged")
def w2(spark, sf):
    folder = _streamed(spark, sf)
    # folding the batches into one must change nothing
    b.compact(spark, f"{folder}/out")
    return b.read_inventory(spark, f"{folder}/out").select(
        "dedup_key", "ts", "message_id", "society", "dealer", "is_duplicate"
    )


@check("w2_levels_before_and_after", f"""{KEPT_WITH}
    SELECT state, dedup_key, ts, message_id, is_duplicate FROM flagged, (VALUES ('merging'), ('compacted')) AS s(state)""")
def w2_levels(spark, sf):
    folder = new_path(spark, "stream")
    # two runs of a level merge, beside the stream
    b.stream_inventory(_stream(spark, sf), f"{folder}/out", f"{folder}/checkpoint", REGISTRY, f"{folder}/cache", fan=2).awaitTermination()
    merging = b.snapshot(spark, f"{folder}/out")
    b.compact(spark, f"{folder}/out", keep_old=True)
    states = [("merging", merging), ("compacted", b.snapshot(spark, f"{folder}/out"))]
    parts = [b.read_inventory(spark, f"{folder}/out", at).select(F.lit(state).alias("state"), "dedup_key", "ts", "message_id", "is_duplicate")
             for state, at in states]
    return parts[0].unionByName(parts[1])


@check("w3_cache_across_batches", f"""{ads_with()}
    SELECT sha256(text) AS digest, CAST(1 AS BIGINT) AS times_parsed, 4 AS batches FROM ads GROUP BY text""")
def w3(spark, sf):
    folder = _streamed(spark, sf)
    entries = spark.read.parquet(f"{folder}/cache").groupBy("digest").agg(F.count("*").alias("times_parsed"))
    batches = spark.read.parquet(f"{folder}/out").select("batch").distinct().count()
    return entries.withColumn("batches", F.lit(batches))
