"""Levelled tables: growth, snapshots, concurrent writers, killed merges, and edits by bucket, against plain models."""

import datetime as dt
import glob
import random
import threading

import pytest
from pyspark.sql import functions as F

import brickledger as b
from brickledger.operators import levels as L
from brickledger.operators import managed_table as M
from brickledger.operators.dedup import earliest_per
from brickledger.operators.managed_table import edited_buckets
from brickledger.operators.storage import children, create_text, new_path, read_text, shared_folder
from brickledger.streaming.inventory_stream import merged_listings
from test_inventory import REGISTRY, SCHEMA, found, plain_inventory, random_posts


def least(spark, path, fan=3):
    """Keys with the least value met."""
    return L.Levels(spark, path, "k", lambda rows: earliest_per(rows, ["k"], ["v"]), fan)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "k string, v long")


def plain(rows):
    made = {}
    for k, v in rows:
        made[k] = min(made.get(k, v), v)
    return made


def read(df):
    return {r.k: r.v for r in df.collect()}


def test_runs_grow_with_the_logarithm_and_old_snapshots_stay_readable(spark):
    draw, path, seen, opened = random.Random(1), new_path(spark, "levels"), [], []
    table = least(spark, path)
    for batch in range(13):
        rows = [(f"k{draw.randrange(30)}", draw.randrange(1000)) for _ in range(20)]
        table.append(pairs(spark, list(plain(rows).items())), batch)
        seen += rows
        now = table.settle()
        assert len(now.runs) <= 2 * 3 and max(sum(r.level == x.level for r in now.runs) for x in now.runs) < 3
        opened.append((now, plain(seen)))
    assert sorted(r.level for r in now.runs) == [0, 1, 2]  # 13 in threes
    for at, wanted in opened:
        assert read(table.rows(at)) == wanted
    one = table.compact()
    assert len(one.runs) == 1 and read(table.rows()) == plain(seen)
    assert "Window" not in table.rows()._jdf.queryExecution().executedPlan().toString()
    assert read(table.rows(opened[5][0])) == opened[5][1]
    L.vacuum(spark, path, keep=1)
    assert children(spark, path) == [L.SNAPSHOTS, one.runs[0].name] and read(table.rows()) == plain(seen)


def test_a_repeated_batch_changes_nothing(spark):
    path = new_path(spark, "levels")
    table = least(spark, path)
    for batch, rows in ((0, [("a", 5)]), (1, [("a", 4), ("b", 1)]), (1, [("a", 0)]), (0, [("c", 0)])):
        table.append(pairs(spark, rows), batch)
    assert read(table.rows()) == {"a": 4, "b": 1} and L.snapshot(spark, path).last_batch == 1
    # a batch that was written but not committed is written over
    pairs(spark, [("z", 9)]).write.parquet(f"{path}/batch=2")
    assert read(table.rows()) == {"a": 4, "b": 1}
    table.append(pairs(spark, [("c", 7)]), 2)
    assert read(table.rows()) == {"a": 4, "b": 1, "c": 7}


def test_a_killed_merge_leaves_the_snapshot(spark, monkeypatch):
    path = new_path(spark, "levels")
    table = least(spark, path)
    for batch in range(4):
        table.append(pairs(spark, [(f"k{i}", 10 * batch + i) for i in range(batch, batch + 5)]), batch)
    before, wanted = L.snapshot(spark, path), read(table.rows())

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(L, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        L.Levels._fold(table, before, before.runs, 1)
    monkeypatch.undo()
    assert L.snapshot(spark, path) == before and read(table.rows()) == wanted
    assert len(table.compact().runs) == 1 and read(table.rows()) == wanted


def test_writers_beside_each_other(spark):
    path, rows = new_path(spark, "levels"), {}
    table = least(spark, path, fan=2)
    table.open()
    for batch in range(6):
        rows[batch] = [(f"k{(7 * batch + i) % 11}", (13 * batch + 5 * i) % 50) for i in range(6)]

    def stream():
        for batch, some in rows.items():
            table.append(pairs(spark, some), batch)

    def merge():
        for _ in range(4):
            if L.snapshot(spark, path).runs:
                table.compact()

    threads = [threading.Thread(target=f) for f in (stream, merge)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table.settle()
    assert read(table.rows()) == plain([r for some in rows.values() for r in some])
    assert L.snapshot(spark, path).last_batch == 5


def test_the_first_of_two_commits_wins(spark):
    path = new_path(spark, "levels")
    assert create_text(spark, f"{path}/one.json", "first") and not create_text(spark, f"{path}/one.json", "second")
    assert read_text(spark, f"{path}/one.json") == "first" and children(spark, path) == ["one.json"]
    assert children(spark, f"{path}/none") == []
    calls = []

    def change(now):
        if not calls:  # another writer is faster
            L.commit(spark, path, lambda n: L.replace(n, last_batch=7))
        calls.append(now.version)
        return L.replace(now, runs=(L.Run("r", 0, 1),))

    made = L.commit(spark, path, change)
    assert calls == [0, 1] and (made.version, made.last_batch) == (2, 7)


def test_batches_without_a_snapshot_are_read_as_they_are(spark):
    path = new_path(spark, "levels")
    for batch in range(2):
        pairs(spark, [("a", 3 - batch), (f"b{batch}", 1)]).write.parquet(f"{path}/batch={batch}")
    table = least(spark, path)
    assert read(table.rows()) == {"a": 2, "b0": 1, "b1": 1}
    table.append(pairs(spark, [("a", 1)]), 2)
    assert L.snapshot(spark, path).version == 2 and read(table.rows().select("k", "v")) == {"a": 1, "b0": 1, "b1": 1}
    with pytest.raises(FileNotFoundError):
        least(spark, new_path(spark, "levels")).rows()


def test_stream_read_and_compacted_while_it_grows(spark):
    posts = random_posts(8, 150)
    folder = new_path(spark, "test-stream")
    before_folders = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/stored-*"))
    checkpoints = []
    for k in range(5):
        spark.createDataFrame(posts[k::5], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        b.stream_inventory(source, f"{folder}/out", f"{folder}/checkpoint", REGISTRY, f"{folder}/cache", fan=2).awaitTermination()
        seen = [p for i in range(k + 1) for p in posts[i::5]]
        checkpoints.append((b.snapshot(spark, f"{folder}/out"), plain_inventory(seen)))
        if k == 3:
            b.compact(spark, f"{folder}/out", keep_old=True)
    assert set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/stored-*")) == before_folders
    for at, wanted in checkpoints:  # every state can still be read
        with b.scratch(spark):
            assert found(b.read_inventory(spark, f"{folder}/out", at)) == wanted
    assert max(len(at.runs) for at, _ in checkpoints) <= 3
    b.compact(spark, f"{folder}/out")
    assert len(children(spark, f"{folder}/out")) == 2
    assert merged_listings(spark, f"{folder}/out").count() == len(plain_inventory(posts))
    assert merged_listings(spark, f"{folder}/out").filter(F.col("dedup_key").isNull()).count() == 0


# ----------------------------------------------------------------- edits by bucket

def flags(rows):
    """``{key: (society, dealer, price, is_duplicate)}`` with the flags that the rows should have."""
    newest = {}
    for r in rows:
        newest[r.society, r.dealer] = max(newest.get((r.society, r.dealer), ()), (r.ts, r.chat_id, r.message_id, r.part_no))
    return {r.dedup_key: (r.society, r.dealer, r.price, (r.ts, r.chat_id, r.message_id, r.part_no) != newest[r.society, r.dealer]) for r in rows}


def held(rows):
    return {r.dedup_key: (r.society, r.dealer, r.price, r.is_duplicate) for r in rows}


def files(path, run=""):
    return {f: open(f, "rb").read() for f in glob.glob(f"{path.removeprefix('file:')}/batch=*{run}/part-*")}


def test_edits_touch_their_buckets_only(spark):
    draw, path = random.Random(3), new_path(spark, "managed")
    rows = b.build_inventory(spark.createDataFrame(random_posts(11, 200), SCHEMA), REGISTRY)
    b.write_managed(rows, path)
    model = rows.select(*[c for c in rows.columns if c != "is_duplicate"])
    every = []
    for hour in range(1, 7):
        when = dt.datetime(2024, 1, 1, hour)
        keys = sorted(r.dedup_key for r in b.read_managed(spark, path).collect())
        some = b.read_managed(spark, path).filter(F.col("dedup_key").isin(draw.sample(keys, 2)))
        if hour % 3 == 0:
            edits = b.delete_listing(some, when)
        elif hour == 4:
            edits = b.new_listing(some.select(*b.schemas.INVENTORY_FIELDS), REGISTRY, when)
        else:
            edits = b.update_listing(some.withColumn("society", F.lit("SOBHA CITY")).withColumn("price", F.lit(f"{hour} CR")), when)
        edits = b.operators.storage.stored(edits)
        every.append(edits)
        before, at = files(path), b.snapshot(spark, path)
        after = b.edit_managed(spark, path, edits)
        assert {f: c for f, c in files(path).items() if f in before} == before
        made = [r for r in after.runs if r not in at.runs and not r.without]
        written = spark.read.parquet(f"{path}/{made[0].name}")
        assert len(made) == 1 and written.select("bucket").distinct().count() < 20 and made[0].rows < 30
        model = b.apply_edits(model, edits)
        assert held(b.read_managed(spark, path).collect()) == flags(model.collect())
        assert held(b.read_managed(spark, path, at).collect()) != held(b.read_managed(spark, path).collect())
    assert b.managed(spark, path).compact().runs[0].rows == model.count()
    assert held(b.read_managed(spark, path).collect()) == flags(model.collect())


def test_one_edit_rewrites_one_bucket_without_an_exchange(spark):
    path = new_path(spark, "managed")
    b.write_managed(b.build_inventory(spark.createDataFrame(random_posts(12, 200), SCHEMA), REGISTRY), path)
    at = b.snapshot(spark, path)
    one = b.read_managed(spark, path).orderBy("dedup_key").limit(1).withColumn("price", F.lit("9 CR"))
    edits = b.operators.storage.stored(b.update_listing(one, dt.datetime(2024, 1, 1)))
    touched, rows = edited_buckets(L.run_rows(spark, path, at.runs, at.schema), edits)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(touched) == 1 and "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan and "bucket" in plan.split("PushedFilters")[1]
    after = b.edit_managed(spark, path, edits)
    assert after.runs[0].without == tuple(touched) and after.runs[1].rows == rows.count()
    assert b.edit_managed(spark, path, edits.limit(0)) == after
    stranger = b.delete_listing(spark.createDataFrame([("nobody",)], "dedup_key string"), dt.datetime(2024, 1, 1))
    wanted = held(b.read_managed(spark, path).collect())
    b.edit_managed(spark, path, stranger)
    assert held(b.read_managed(spark, path).collect()) == wanted
    with pytest.raises(ValueError):
        b.write_managed(one.drop("is_duplicate"), path)


def test_edits_of_two_users_at_once(spark, monkeypatch):
    path = new_path(spark, "managed")
    b.write_managed(b.build_inventory(spark.createDataFrame(random_posts(13, 60), SCHEMA), REGISTRY), path)
    keys = sorted(r.dedup_key for r in b.read_managed(spark, path).collect())

    def price(key, value, hour):
        row = b.read_managed(spark, path).filter(F.col("dedup_key") == key).withColumn("price", F.lit(value))
        return b.operators.storage.stored(b.update_listing(row, dt.datetime(2024, 1, 1, hour)))

    first, second, original, calls = price(keys[0], "1 CR", 1), price(keys[1], "2 CR", 2), M.commit, []

    def late(spark_, path_, change):
        if not calls:  # the other user commits just before
            calls.append(1)
            b.edit_managed(spark, path, second)
        return original(spark_, path_, change)

    monkeypatch.setattr(M, "commit", late)
    b.edit_managed(spark, path, first)
    prices = {r.dedup_key: r.price for r in b.read_managed(spark, path).collect()}
    assert (prices[keys[0]], prices[keys[1]], len(prices)) == ("1 CR", "2 CR", len(keys))
