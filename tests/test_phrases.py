"""Custom names by look-up, against every rule in turn."""

import random
import time

from pyspark.sql import functions as F

import brickledger as b
from brickledger import registry as R

WORDS = ["Lake", "Orchid", "the", "Hills", "é", "café", "M3M", "65", "A-B", "(East)", "Straße", "दिल्ली", "K", "_x", "ok.", "東京", "Phase", "2", "x²"]


def names(draw, n, words=WORDS):
    return [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 5))) for _ in range(n)]


def texts(draw, own, n):
    made = []
    for _ in range(n):
        name = draw.choice(own)
        name = draw.choice([name, name.upper(), name.lower(), name.replace(" ", "  \n"), name + "s", "é" + name, name[:-1], "_" + name, name + "²", name + "́"])
        made.append(draw.choice(["", "two in ", "x", "é ", "-"]) + name + draw.choice(["", " now", ",", "x", "_", " é"]))
    return made + [None, "", "  ", "K", "maſon lake", "STRASSE"]


def test_names_in_texts_as_every_rule_finds_them(spark):
    for seed, words in ((1, [w for w in WORDS if w != "Straße"]), (2, WORDS), (3, ["Lake", "Orchid", "the", "Hills", "M3M", "2"])):
        draw = random.Random(seed)
        own = names(draw, 60, words)
        df = spark.createDataFrame([(t,) for t in texts(draw, own, 1500)], "t string").repartition(8)
        pairs = [(n, f"{i}") for i, n in enumerate(own)]
        rules = [R.Phrase(i, (), R.P.ci(R._phrase(n)), p) for i, (n, p) in enumerate(pairs)]
        every = R.every_one(rules, lambda pattern: F.rlike(F.col("t"), pattern))["project"]
        got = df.select("t", R._first_named(F.col("t"), pairs).alias("a"), every.alias("b")).collect()
        assert [r for r in got if r.a != r.b] == [] and sum(r.a is not None for r in got) > 300


def test_project_names_as_every_spelling_finds_them(spark):
    draw = random.Random(4)
    own = names(draw, 80, ["Lake", "Orchid", "Maple", "Wood", "M3M", "Heights", "Bay", "O"])
    registry = b.Registry()
    for n in own:
        registry = registry.add(n, [n + " Phase 2"])
    asked = [draw.choice(own)[draw.randrange(3):] + draw.choice(["", " Tower", "x"]) for _ in range(600)] + ["", "Sobha City", "godrej icon"]
    df = spark.createDataFrame([(t,) for t in asked], "t string")
    got = df.select("t", registry.canonical_name(F.col("t")).alias("p"), b.normalize_project_name(F.col("t")).alias("n"), b.Registry().canonical_name(F.col("t")).alias("built_in")).collect()
    for r in got:
        wanted = next((p for p, spelling in registry.name_spellings() if spelling in r.n), r.built_in) if r.n else ""
        assert r.p == wanted, r


def test_ten_thousand_names_cost_little_more_than_ten(spark):
    draw = random.Random(5)
    many = [f"{draw.choice('abcdefgh')}{draw.randrange(10**6)} Court {i}" for i in range(10_000)]
    df = spark.createDataFrame([(f"a flat of {draw.randrange(900, 2000)} sqft in {draw.choice(many)}, tower {i % 9}, asking 2.5 cr",) for i in range(20_000)], "t string").repartition(8).cache()
    df.count()

    def seconds(own):
        took = []
        for _ in range(3):
            start = time.time()
            hits = df.filter(R._first_named(F.col("t"), [(n, n) for n in own]).isNotNull()).count()
            took.append(time.time() - start)
        return min(took), hits

    few, hits = seconds(many[:10])
    all_of_them, all_hits = seconds(many)
    assert hits < 100 and all_hits == 20_000
    print("seconds for 10 and 10,000 names:", few, all_of_them)
    assert all_of_them < 2 * few + 3  # 3 s: the table itself, and 20,000 hits that are tested
