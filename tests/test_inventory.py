"""Deduplication, cache, edits, files and streams, against plain Python models of them."""

import datetime as dt
import glob
import json
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

import brickledger as b
from brickledger.operators import chats
from brickledger.operators.dedup import earliest_per
from brickledger.operators.ranking import numbered, running_number
from brickledger.operators.skew import heavy_keys, spread_join
from brickledger.operators.storage import new_path, replacing, shared_folder, stored
from brickledger.plans.inventory import cache_version, compact_parse_cache, distinct_texts, read_parse_cache
from checks.inputs import chat_tables

REGISTRY = b.Registry()
SCHEMA = "chat_id long, message_id long, timestamp_ms long, sender string, text string"
SF = "/root/testdata/sf0.001"
SENDERS = ["919812300001", "919812300002", "919812300003"]


def offer(i):
    """One of twelve offers in four societies; none names a dealer."""
    society = ["Sobha City", "Godrej Icon", "Lake Court Residency", "Silver Oak Heights"][i % 4]
    return f"{society}\n{2 + i % 3} BHK\n{1000 + 50 * i} sqft\nasking {1 + i}.25 cr"


def random_posts(seed, n=90):
    draw = random.Random(seed)
    return [(draw.randrange(5), i, 1_600_000_000_000 + 1000 * draw.randrange(25), draw.choice(SENDERS), offer(draw.randrange(12))) for i in range(n)]


def plain_inventory(posts):
    """``{(text, sender): (ts, chat, message, newest of its society and sender)}``."""
    first = {}
    for chat, message, ts, sender, text in posts:
        first[text, sender] = min(first.get((text, sender), (ts, chat, message)), (ts, chat, message))
    newest = {}
    for (text, sender), moment in first.items():
        group = text.split("\n")[0], sender
        newest[group] = max(newest.get(group, moment), moment)
    return {key: (*moment, moment != newest[key[0].split("\n")[0], key[1]]) for key, moment in first.items()}


def found(inventory):
    return {(r.full_message, r.dealer): (r.ts, r.chat_id, r.message_id, r.is_duplicate) for r in inventory.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_inventory_of_random_posts(spark, seed):
    posts = random_posts(seed)
    wanted = plain_inventory(posts)
    for parts in (1, 5):
        messages = spark.createDataFrame(posts, SCHEMA).repartition(parts)
        assert found(b.build_inventory(messages, REGISTRY)) == wanted


def test_stream_of_random_batches_and_its_cache(spark):
    posts = random_posts(3, 120)
    folder = new_path(spark, "test-stream")
    for k in range(3):
        spark.createDataFrame(posts[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    b.stream_inventory(source, f"{folder}/out", f"{folder}/checkpoint", REGISTRY, f"{folder}/cache").awaitTermination()
    assert len(glob.glob(f"{folder}/out/batch=*".removeprefix("file:"))) == 3
    assert found(b.read_inventory(spark, f"{folder}/out")) == plain_inventory(posts)
    assert spark.read.parquet(f"{folder}/cache").count() == len({p[4] for p in posts})
    b.compact(spark, f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out").select("batch").distinct().count() == 1
    assert found(b.read_inventory(spark, f"{folder}/out")) == plain_inventory(posts)


def test_cache_entries_by_version_and_prefix(spark):
    cache, version = new_path(spark, "test-cache"), cache_version(REGISTRY)
    messages = spark.createDataFrame([(1, i, 5, "s", t) for i, t in enumerate([offer(0), offer(1), "nothing on offer", offer(0)])], SCHEMA)
    assert b.extract_once(messages, REGISTRY, cache).count() == 3
    assert read_parse_cache(spark, cache, version).count() == 3
    one = distinct_texts(messages.limit(1))
    assert read_parse_cache(spark, cache, version, one).count() == 1
    # entries whose listings are damaged are parsed again
    broken = new_path(spark, "test-cache")
    spark.read.parquet(cache).withColumn("listings", F.when(F.lit(False), F.col("listings"))).write.partitionBy("version", "prefix").parquet(broken)
    assert b.extract_once(messages, REGISTRY, broken).count() == 3
    compact_parse_cache(spark, broken)
    assert spark.read.parquet(broken).count() == 3 and b.extract_once(messages, REGISTRY, broken).count() == 3
    assert read_parse_cache(spark, cache, cache_version(REGISTRY.add("Mill Pond"))).count() == 0


def test_random_edits_against_a_dictionary(spark):
    draw = random.Random(9)
    rows = stored(b.build_inventory(spark.createDataFrame(random_posts(4), SCHEMA), REGISTRY))
    start, changes = dt.datetime(2024, 1, 1), []
    keys = sorted(r.dedup_key for r in rows.collect())
    for hour in range(1, 7):
        some = rows.filter(F.col("dedup_key").isin(draw.sample(keys, 4)))
        when = start + dt.timedelta(hours=hour)
        if draw.random() < 0.7:
            moved = some.withColumn("society", F.lit(draw.choice(["SOBHA CITY", "GODREJ ICON"]))).withColumn("price", F.lit(f"{hour} CR"))
            changes.append(b.update_listing(moved, when))
        else:
            changes.append(b.delete_listing(some, when))
    edits = reduce(lambda x, y: x.unionByName(y), changes)
    # the last edit of a listing counts, so one that follows a deletion brings it back
    edited = b.apply_edits(rows, edits)
    last = {}
    for r in edits.collect():
        last[r.id] = max(last.get(r.id, (r.edited_at, r.op)), (r.edited_at, r.op))
    base = {r.dedup_key: r for r in rows.collect()}
    gone = {k for k, (_, op) in last.items() if op == "delete"}
    kept = {r.dedup_key: r for r in edited.collect()}
    assert set(kept) == set(base) - gone
    newest = {}
    for k, r in kept.items():
        assert (r.ts, r.message_id) == (base[k].ts, base[k].message_id)
        if k in last:
            assert r.price == f"{int((last[k][0] - start).total_seconds() // 3600)} CR"
        else:
            assert r.price == base[k].price
        newest[r.society, r.dealer] = max(newest.get((r.society, r.dealer), ()), (r.ts, r.chat_id, r.message_id))
    for r in kept.values():
        assert r.is_duplicate == ((r.ts, r.chat_id, r.message_id) != newest[r.society, r.dealer])


def test_added_listings_and_unknown_ids(spark):
    rows = stored(b.build_inventory(spark.createDataFrame(random_posts(5, 20), SCHEMA), REGISTRY))
    at = dt.datetime(2024, 3, 1)
    typed = rows.filter("society = 'SOBHA CITY'").limit(1).withColumn("status", F.lit(" ")).select(*b.schemas.INVENTORY_FIELDS)
    stranger = b.delete_listing(spark.createDataFrame([("nobody",)], "dedup_key string"), at)
    edited = b.apply_edits(rows, b.new_listing(typed, REGISTRY, at).unionByName(stranger)).collect()
    added = [r for r in edited if r.dedup_key.startswith("manual_")]
    assert len(edited) == rows.count() + 1 and [r.status for r in added] == ["IN"]
    beaten = [r for r in edited if (r.society, r.dealer) == (added[0].society, added[0].dealer) and r is not added[0]]
    assert beaten and all(r.is_duplicate for r in beaten) and not added[0].is_duplicate


def test_summaries_and_moved_societies(spark):
    rows = stored(b.build_listings(spark.createDataFrame(random_posts(6), SCHEMA), REGISTRY))
    listed = [r.society for r in rows.collect()]
    curated = {r.society: r.total_listings for r in b.curated_summaries(rows, REGISTRY).collect()}
    assert len(curated) == len(REGISTRY.names())
    assert all(curated[n] == listed.count(n) for n in ("SOBHA CITY", "GODREJ ICON")) and sum(map(bool, curated.values())) == 2
    outside = {r.society for r in b.out_summaries(rows, REGISTRY).collect()}
    moved, registry, count = b.promote_society(rows, REGISTRY, "lake court residency", dt.datetime(2024, 1, 1))
    assert count.first().listings == sum(s.upper() == "LAKE COURT RESIDENCY" for s in listed) and len(registry.names()) == len(REGISTRY.names()) + 1
    assert {s.upper() for s in outside} - {r.society.upper() for r in b.out_summaries(moved, registry).collect()} == {"LAKE COURT RESIDENCY"}


def test_registry_of_the_user(spark, tmp_path):
    registry = REGISTRY.add("Mill Pond Villas", ["POND  VILLAS PHASE 2"]).add("godrej icon").add(" ")
    assert len(registry.names()) == len(REGISTRY.names()) + 1 and registry.remove("mill pond villas") == REGISTRY
    b.write_registry(spark, registry, str(tmp_path / "own"))
    assert b.read_registry(spark, str(tmp_path / "own")) == registry == b.read_registry(spark, str(tmp_path / "own"), max_projects=None)
    assert b.read_registry(spark, str(tmp_path / "missing")) == REGISTRY
    with pytest.raises(ValueError):
        b.read_registry(spark, str(tmp_path / "own"), max_projects=0)
    df = spark.createDataFrame([("two flats left in Pond Villas  Phase 2",)], "t string")
    assert df.select(registry.canonical_in_text(F.col("t"))).first()[0] == "MILL POND VILLAS"


def test_csv_bytes_and_a_failing_export(spark, tmp_path):
    path = str(tmp_path / "csv")
    text = offer(0) + '\n"corner", lift'
    rows = b.build_inventory(spark.createDataFrame([(1, 1, 7, "@sum", text), (2, 2, 9, "tab\there", offer(5))], SCHEMA), REGISTRY)
    b.write_inventory_csv(rows, path)
    data = b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/part-*")))
    assert data.startswith(b"\xef\xbb\xbfSOCIETY,") and data.endswith(b"\r\n") and data.count(b"\r\n") == 3
    first = data.decode().split("\r\n")[1]
    assert first.split(",")[0] == "SOBHA CITY" and first.endswith(',false') and '| ""corner"", lift"' in first
    broken = rows.withColumn("price", F.raise_error(F.lit("no price")))
    with pytest.raises(Exception):
        b.write_inventory_csv(broken, path)
    assert b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/part-*"))) == data
    assert glob.glob(f"{path}.*") == []


def test_replacing_and_scratch(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in (3, 5):
        with replacing(spark, path) as staged:
            spark.range(n).write.parquet(staged)
        assert spark.read.parquet(path).count() == n
    with pytest.raises(RuntimeError), replacing(spark, path) as staged:
        spark.range(1).write.parquet(staged)
        raise RuntimeError
    assert spark.read.parquet(path).count() == 5
    root = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/*"))
    with b.scratch(spark):
        assert b.build_inventory(spark.createDataFrame(random_posts(7, 10), SCHEMA), REGISTRY).count() > 0
        assert set(glob.glob(f"{root}/*")) - before
    assert set(glob.glob(f"{root}/*")) == before


def test_transcripts_are_documents(spark, tmp_path):
    tables = chat_tables(spark, SF)
    b.export_json(tables, str(tmp_path / "json"), 1)
    for chat in (1, 2, 5):
        document = json.loads("".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "json" / f"chat_id={chat}" / "part-*")))))
        wanted = tables.message.filter(F.col("chat_row_id") == chat).orderBy("timestamp", "_id").collect()
        assert [(m["id"], m["text"], m["timestampMs"]) for m in document["messages"]] == [(r["_id"], r.text_data, r.timestamp) for r in wanted]
        assert document["exportMetadata"]["messageCount"] == len(wanted)


def test_pages_without_an_end(spark):
    tables = chat_tables(spark, SF)
    everything = [(r.timestamp_ms, r.id) for r in b.chat_messages(tables).collect()]
    rest = [(r.timestamp_ms, r.id) for r in b.chat_messages(tables, offset=37).collect()]
    assert rest == sorted(everything)[37:]
    assert b.list_chats(tables, limit=None).count() == tables.chat.count()
    assert b.search_messages(tables, "e", limit=None).count() == tables.message.filter("lower(text_data) LIKE '%e%'").count()
    plan = b.chat_messages(tables, offset=37)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_pages_far_on(spark, monkeypatch):
    tables = chat_tables(spark, SF)
    near = [[r.id for r in b.chat_messages(tables, limit=7, offset=40).collect()], [r.id for r in b.list_chats(tables, limit=5, offset=11).collect()]]
    monkeypatch.setattr(chats, "MOST_TOP_K", 20)
    plan = b.chat_messages(tables, limit=7, offset=40)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan
    far = [[r.id for r in b.chat_messages(tables, limit=7, offset=40).collect()], [r.id for r in b.list_chats(tables, limit=5, offset=16).collect()]]
    assert far[0] == near[0] and len(near[0]) == 7
    monkeypatch.undo()
    assert far[1] == [r.id for r in b.list_chats(tables, limit=5, offset=16).collect()]


def test_schema_check(spark):
    good = {"Chat": spark.range(1), "JID": spark.range(1), "message": spark.createDataFrame([], "Text_Data string, chat_row_id long, timestamp long")}
    assert b.inspect_schema(good).is_supported
    for missing in good:
        with pytest.raises(ValueError):
            b.check_schema({k: v for k, v in good.items() if k != missing})


def test_only_a_missing_table_means_no_map(spark, tmp_path):
    for name, schema in b.schemas.CHAT_TABLES.items():
        if name != "jid_map":
            spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert b.read_chat_tables(spark, str(tmp_path)).jid_map is None
    (tmp_path / "jid_map.parquet").mkdir()
    (tmp_path / "jid_map.parquet" / "part-0.parquet").write_bytes(b"this is no parquet file at all")
    with pytest.raises(Exception):
        b.read_chat_tables(spark, str(tmp_path))


def test_one_key_on_all_rows(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("key"), (F.col("id") * 7919 % 100_003).alias("chat"), (F.col("id") * 104_729_111).alias("message"), "id")
    ours = {r.id: r.n for r in running_number(rows, F.col("key"), "chat", "message", "n").collect()}
    assert ours == {r.id: k for k, r in enumerate(sorted(rows.collect(), key=lambda r: (r.chat, r.message)), 1)}
    plan = numbered(rows, ["key"], ["chat", "message"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_numbers_and_heavy_joins_against_windows(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 41).cast("string")).alias("key"), (F.col("id") * 31 % 701).alias("x"), "id")
    ours = {r.id: r.n for r in numbered(rows, ["key"], ["x", "id"], "n").collect()}
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: (r.x, r.id)):
        groups.setdefault(r.key, []).append(r.id)
    assert ours == {i: k for ids in groups.values() for k, i in enumerate(ids, 1)}
    named = rows.filter("key IS NOT NULL")
    one = named.select("key").distinct().withColumn("value", F.length("key"))
    for most in (1000, 0):
        spread = spread_join(named, one, "key", heavy_keys(named.groupBy("key").count(), "key", "count", 20), ["id"], most)
        assert spread.exceptAll(named.join(one, "key").select(*spread.columns)).count() == 0 and spread.count() == named.count()


def test_plans_reduce_before_shuffling(spark):
    plan = earliest_per(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    page = b.search_messages(chat_tables(spark, SF), "the")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page
