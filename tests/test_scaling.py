"""Where in a plan the costly rules stand."""

import glob
from urllib.parse import unquote

import brickledger as b
from brickledger.operators.dedup import nearly_earliest_per
from brickledger.plans import extraction as X
from checks.inventory import file_lines


def test_posts_are_reduced_before_the_gate(spark):
    rows = [(1, i, 1000 + i, "919000000001", "Sobha City\n3 BHK\nAsking 2 cr\ncall Asha Verma 9000000001") for i in range(20)]
    messages = spark.createDataFrame(rows, "chat_id long, message_id long, timestamp_ms long, sender string, text string")
    plan = b.build_listings(messages, b.Registry())._jdf.queryExecution().optimizedPlan().toString()
    # the plan is read from its end: the first window stands nearer to the source than the first Python function
    assert plan.rindex("row_number()") > plan.rindex("ArrowEvalPython")
    assert [r.message_id for r in b.build_listings(messages, b.Registry()).collect()] == [0]


def test_a_batch_of_one_file_is_dealt_out_before_the_rules(spark, tmp_path):
    rows = [(1, i, 1000 + i, "919000000001", "Sobha City\n3 BHK\nAsking 2 cr") for i in range(40)]
    schema = "chat_id long, message_id long, timestamp_ms long, sender string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    plan = b.earliest_posts_stream(stream, b.Registry())._jdf.queryExecution().analyzed().toString()
    assert plan.rindex("RepartitionByExpression") > plan.rindex("_nfkc(")


def test_extraction_reads_each_text_once_before_the_gate(spark, monkeypatch):
    texts = ["Sobha City\n3 BHK\nAsking 2 cr", "*Sobha City*\n3 BHK\nAsking 2 cr\r", "Godrej Icon\n2 BHK\nAsking 1 cr", "good morning", " ", None]
    rows = [(i % 4, i, 1000 + i, "919000000001", texts[i % 6]) for i in range(60)]
    messages = spark.createDataFrame(rows + rows[:1], "chat_id long, message_id long, timestamp_ms long, sender string, text string")
    kept, store = {}, X.stored
    monkeypatch.setattr(X, "stored", lambda df, label: kept.setdefault(label, store(df, label)))
    # texts with more than four posts are spread over tasks
    found = b.extract_listings(messages, b.Registry(), rows_per_task=4).collect()
    assert sorted(r.message_id for r in found) == sorted([i for i in range(60) if i % 6 < 3] + [0])
    # the numbers go through all posts that read the same without marks, in order of chat and message
    posts = sorted((r.chat_id, r.message_id, r.times_posted) for r in found if r.message_id % 6 < 2)
    assert [n for *_, n in posts] == list(range(1, 22))
    assert kept["gated"].count() == 3


def test_lines_of_exports_are_read_by_parts_of_files(spark, tmp_path):
    for name, n in (("A_B", 500), ("C", 40), ("D", 1)):
        for part in range(2):
            folder = tmp_path / f"out/file_name=Inventory_{name}_1m.csv"
            folder.mkdir(parents=True, exist_ok=True)
            lines = ["\ufeffHEAD é"] * (part == 0) + [f"{name} {part} {i} é" for i in range(n)] + ["\ufefflate mark"] * part
            (folder / f"part-0000{part}.txt").write_bytes("".join(line + "\r\n" for line in lines).encode())
    expected = []
    for folder in glob.glob(f"{tmp_path}/out/*"):
        text = "".join(open(f, newline="", encoding="utf-8").read() for f in sorted(glob.glob(f"{folder}/*")))
        expected += [(unquote(folder).rpartition("=")[2], i, line) for i, line in enumerate(text.split("\r\n")[:-1])]
    # a file spans several tasks, and none is read as one row
    limits = {"files.maxPartitionBytes": "1000", "files.openCostInBytes": "0", "sources.binaryFile.maxLength": "500"}
    before = {key: spark.conf.get(f"spark.sql.{key}") for key in limits}
    try:
        for key, value in limits.items():
            spark.conf.set(f"spark.sql.{key}", value)
        rows = [tuple(r) for r in file_lines(spark, f"{tmp_path}/out").collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(f"spark.sql.{key}", value)
    assert sorted(rows) == sorted(expected)


def test_a_batch_is_reduced_before_the_rules(spark, tmp_path):
    schema = "chat_id long, message_id long, timestamp_ms long, sender string, text string"
    texts = ["Sobha City\n3 BHK\nAsking 2 cr", "Godrej Icon\n2 BHK\nAsking 1 cr", "", None]
    rows = [(i % 3, i, None if i == 77 else (i * 37) % 101, [None, "", "919000000001"][i // 4 % 3], texts[i % 4]) for i in range(96)]
    posts = spark.createDataFrame(rows + rows[:5], schema)
    order = lambda r: ((r[2] is not None, r[2]), r[0], r[1])
    firsts = {}
    for r in sorted(rows, key=order, reverse=True):
        firsts[r[3:]] = r
    keys, by = ["text", "sender"], ["timestamp_ms", "chat_id", "message_id"]
    whole = [tuple(r) for r in nearly_earliest_per(posts, keys, by).collect()]
    assert len(whole) == len(firsts) and set(whole) == set(firsts.values())
    # a task that holds little passes rows on, and none is lost that comes first
    little = [tuple(r) for r in nearly_earliest_per(posts, keys, by, 1).collect()]
    assert set(firsts.values()) <= set(little) <= set(rows)
    posts.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    updates = b.earliest_posts_stream(stream, b.Registry())
    plan = updates._jdf.queryExecution().analyzed().toString()
    # the plan is read from its end: posts are reduced nearer to the source than the first Python function of the rules
    assert plan.rindex("MapInArrow") > plan.rindex("_nfkc(")
    found = []
    query = updates.writeStream.outputMode("update").foreachBatch(lambda batch, _: found.extend(batch.collect()))
    query.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = {(r.dedup_key, r.ts, r.chat_id, r.message_id) for r in found}
    assert kept == {(r.dedup_key, r.ts, r.chat_id, r.message_id) for r in b.build_listings(posts, b.Registry()).collect()}
