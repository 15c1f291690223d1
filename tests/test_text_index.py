"""Indexed search against a scan."""

import random
import re
from collections import defaultdict

import pytest

import brickledger as b
from brickledger.operators import text_index as X
from brickledger.operators.search import like_pattern
from brickledger.operators.storage import new_path
from pyspark.sql import functions as F

LETTERS = ["a", "b", "c", " ", "ä", "Ä", "B", "東", "𝐀", "\\", ".", "\n"]
SCHEMA = "_id long, text_data string, block string, n int"


def random_texts(n, seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(1, 6))) for _ in range(60)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(0, 9))) for _ in range(n)]
    return texts + [None, "", "ab", "x" * 50_000 + "needle" + "y" * 50_000, "ΟΔΟΣ σ", "İstanbul"]


def random_query(draw, texts):
    text = draw.choice([t for t in texts if t and len(t) < 200])
    start = draw.randrange(len(text))
    piece = [c.upper() if draw.random() < 0.3 else c for c in text[start:start + draw.randrange(1, 12)]]
    for _ in range(draw.randrange(3)):
        piece[draw.randrange(len(piece))] = draw.choice("%_")
    return "".join(piece)


@pytest.fixture(scope="module")
def indexed(spark):
    texts = random_texts(900)
    rows = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(texts)], SCHEMA).drop("block")
    path, bits = new_path(spark, "index"), X.BLOCK_BITS
    X.BLOCK_BITS, X.BLOCK = 4, 16
    try:
        index = b.TextIndex(spark, path)
        for batch in range(3):
            index.add(rows.filter(F.col("_id") % 3 == batch).repartition(2), batch, order="_id")
        index.add(rows, 1)  # there already
    finally:
        X.BLOCK_BITS, X.BLOCK = bits, 1 << bits
    return index, rows, texts


def test_no_match_lies_outside_the_blocks_of_a_thousand_patterns(spark, indexed):
    index, _, texts = indexed
    draw = random.Random(2)
    queries = [random_query(draw, texts) for _ in range(1000)]
    lowered = [r[0] for r in spark.createDataFrame([(q.strip(),) for q in queries], "q string").select(F.lower("q")).collect()]
    postings = defaultdict(set)
    for r in index._table("grams").collect():
        assert (r.batch, r.block) not in postings[r.gram]
        postings[r.gram].add((r.batch, r.block))
    stored = [(r.batch, r.block, r._id, r.low) for r in index._table("rows").withColumn("low", F.lower("text_data")).collect() if r.low is not None]
    pruned = 0
    for low in lowered:
        pattern = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in low), re.S)
        wanted = {(batch, block) for batch, block, _, text in stored if len(text) < 1000 and pattern.search(text)}
        grams = X.looked_up(low)
        if grams:
            hit = set.intersection(*[postings[g] for g in grams])
            assert wanted <= hit
            pruned += len(hit) < len({s[:2] for s in stored}) / 2
    assert pruned > 100  # the letters are few, so most trigrams are everywhere


def test_searches_give_what_a_scan_gives(spark, indexed):
    index, rows, texts = indexed
    draw = random.Random(3)
    some = ["needle", "ΟΔΟΣ", "istanbul", "İstan", "no such text anywhere", "ab%", "a_b c", "\\b\\", "X%needle%y"]
    for query in some + [random_query(draw, texts) for _ in range(8)]:
        wanted = sorted(r._id for r in rows.filter(F.col("text_data").ilike(like_pattern(query))).collect())
        if index.hit_blocks(query) is None:
            with pytest.warns(UserWarning, match="every row is read"):
                found = index.search(query)
        else:
            found = index.search(query)
        assert sorted(r._id for r in found.collect()) == wanted and found.columns == ["_id", "text_data", "n"]


def test_only_hit_ranges_are_read(spark, indexed, monkeypatch):
    index, rows, _ = indexed
    found = index.search("needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(block" in plan and "PartitionFilters: [" in plan
    assert found.count() == 1 and index.hit_blocks("needle").count() == 1
    found.collect()
    scan = found._jdf.queryExecution().executedPlan()
    scans = scan.collectLeaves()
    read = sum(scans.apply(i).metrics().apply("numOutputRows").value() for i in range(scans.size()))
    assert 0 < read <= 64 < rows.count()
    monkeypatch.setattr(X, "MOST_BLOCKS", 1)
    wide = sorted(r._id for r in index.search("a b").collect())
    assert wide == sorted(r._id for r in rows.filter(F.col("text_data").ilike("%a b%")).collect())


def test_ranges_and_literals():
    assert X.ranges([]) == [] and X.ranges([3]) == [(3, 3)] and X.ranges([1, 2, 3, 7, 9, 10]) == [(1, 3), (7, 7), (9, 10)]
    assert X.looked_up("ab%cdef_gh") == ["cde", "def"] and X.looked_up("a_%") == []
    assert len(X.looked_up("abcdefghijklmnopqrstuvwxyz")) == X.MOST_LOOKED_UP


def test_no_batch(spark):
    with pytest.raises(FileNotFoundError):
        b.TextIndex(spark, new_path(spark, "index")).search("three")
