import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from brickledger.llm import mixing, packing, simhash
from brickledger.llm.common import components, word_count
from brickledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Sets:
    """Plain union-find: the root of a set is its smallest member."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


# ------------------------------------------------------------------- components

def test_components_of_chains_stars_and_noise(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(200, 300)] + [(7, i) for i in range(400, 500)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (90, 2))]
    sets = Sets({n for e in edges for n in e})
    for a, b in edges:
        sets.join(a, b)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: sets.root(n) for a, b in edges if a != b for n in (a, b)}


# ---------------------------------------------------------------------- SimHash

def plain_fingerprint(text, width):
    w = (text or "").encode().lower().split()
    made = [b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in made]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_messy_rows(spark, messy, no_docs):
    found = simhash.near_duplicate_classes(messy).collect()
    wanted = Counter((r["doc_id"], plain_fingerprint(r["text"], 3)) for r in messy.collect())
    assert Counter((r["id"], r["fp"] % (1 << 64)) for r in found) == wanted
    empty = {r["class"] for r in found if r["fp"] == 0}
    assert empty == {20} and {r["class"] for r in found if r["id"] in (31, 32)} == {31}
    assert simhash.near_duplicate_classes(no_docs).count() == 0


def test_links_of_random_and_dense_fingerprints(spark):
    rng = np.random.default_rng(2)
    far = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2)
    dense = np.uint64(0x0123456789ABCDEF) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 3)).astype(np.uint64), axis=1)
    near = far[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([far, dense, near, [np.uint64(0), np.uint64(3), np.uint64(15)]]))
    signed = fps.view(np.int64).tolist()
    sets = Sets(signed)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= 2) + i + 1:
            sets.join(signed[i], signed[int(j)])
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, block_rows=64)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(found.get(f, f) == sets.root(f) for f in signed)


def test_search_leaves_nothing_out():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 12, 300, dtype=np.uint64)
    fps = fps[np.argsort(simhash.gray_ranks(fps))]
    tree = simhash.GrayTree(fps, fps)
    q, leaf = tree.search(fps[:50], 2)
    wanted = {(i, j) for i in range(50) for j in range(300) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert set(zip(q.tolist(), leaf.tolist())) == wanted
    assert [len(x) for x in simhash.GrayTree(fps[:0], fps[:0]).search(fps, 2)] == [0, 0]


def edited(words, at):
    return [f"edit{i}" if i in at else w for i, w in enumerate(words)]


def test_one_of_each_against_all_pairs(spark, messy, no_docs):
    rng = np.random.default_rng(4)
    rows, i = [], 1000
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for edits in (0, 0, 1, 2, 2, 3, 5, 9):
            rows.append((i, " ".join(edited(base, set(rng.integers(0, 120, edits).tolist())))))
            i += 1
    rows += [(7000 + k, " ".join(["shared"] * 3 + [f"u{k}_{j}" for j in range(30)])) for k in range(20)]
    plain = {d: frozenset(tuple(t.split()[j:j + 5]) for j in range(max(1, len(t.split()) - 4))) for d, t in rows}
    sets = Sets(plain)
    for a, b in itertools.combinations(plain, 2):
        both = len(plain[a] & plain[b])
        if both >= 0.8 * (len(plain[a]) + len(plain[b]) - both):
            sets.join(a, b)
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {sets.root(d) for d in plain}
    kept = simhash.one_of_each(messy)
    assert kept.columns == messy.columns
    found = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in found if x is not None and x >= 20) == [20, 22, 30, 31, 33] or sorted(x for x in found if x is not None and x >= 20) == [20, 30, 31, 33]
    assert found.count(None) == 1 and simhash.one_of_each(no_docs).count() == 0


def kept_of_all_pairs(rows):
    plain = {d: frozenset(tuple(t.split()[j:j + 5]) for j in range(max(1, len(t.split()) - 4))) for d, t in rows}
    sets = Sets(plain)
    for a, b in itertools.combinations(plain, 2):
        both = len(plain[a] & plain[b])
        if both >= 0.8 * (len(plain[a]) + len(plain[b]) - both):
            sets.join(a, b)
    return {sets.root(d) for d in plain}


def test_one_of_each_links_to_texts_that_left_their_group(spark):
    """Families of a head with copies, one of which is similar to a text that the heads are not similar to."""
    rows, i = [], 0
    for family in range(12):
        base = [f"f{family}_{j}" for j in range(120)]
        far = edited(base, {119})
        texts = [base, *([f"first{k}", *base[1:]] for k in range(6)), far, edited(far, {1, 30, 70})]
        rows += [(i + k, " ".join(t)) for k, t in enumerate(texts)]
        i += len(texts)
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = kept_of_all_pairs(rows)
    assert len(wanted) == 12 and {r["doc_id"] for r in kept.collect()} == wanted


def test_unlike_copies_of_one_text_are_not_compared_with_each_other(spark, monkeypatch):
    """Copies with four changed words are farther from the base and from each other than 0.8 allows; no pair of them is asked for."""
    base = [f"b{j}" for j in range(150)]
    rows = [(0, " ".join(base)), (1, " ".join(edited(base, {75})))]
    rows += [(2 + k, " ".join(f"c{k}_{j}" if j in (10 + k % 20, 50 + k % 17, 90 + k % 13, 130 + k % 11) else w for j, w in enumerate(base)))
             for k in range(200)]
    asked, plain = [], simhash.overlaps

    def counted(pairs, shingled, similarity):
        asked.append(pairs.count())
        return plain(pairs, shingled, similarity)
    monkeypatch.setattr(simhash, "overlaps", counted)
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == kept_of_all_pairs(rows) and 1 not in kept and len(kept) > 150
    assert sum(asked) < len(rows)


def test_one_of_each_of_small_sets_at_the_very_similarity(spark):
    """Pairs of 4n of 5n shingles, and of all sizes from 1 to 20 with as few in common as 0.8 allows, and one less."""
    rows, i = [], 0
    for size in range(1, 21):
        for larger in range(size, min(5 * size // 4, 20) + 1):
            least = -(-4 * (size + larger) // 9)
            for both in {max(least - 1, 1), least}:
                for copy in range(3):
                    name = f"p{size}_{larger}_{both}_{copy}"
                    first = [f"{name}_{j}" for j in range(size + 4)]
                    # the last ``both`` shingles of the first text open the second one
                    second = first[size - both:] + [f"{name}_x{j}" for j in range(larger - both)]
                    rows += [(i, " ".join(first)), (i + 1, " ".join(second))]
                    i += 2
    rows += [(i + k, f"one passage of several words that stands in all of these texts a{k} b{k} c{k} d{k} e{k} f{k} g{k}") for k in range(30)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = kept_of_all_pairs(rows)
    assert len(wanted) < len(rows) and {r["doc_id"] for r in kept.collect()} == wanted


# ----------------------------------------------------------------------- mixing

def mix_rows(df):
    return [(r["row"]["doc_id"], r["size"], r["source_size"], r["target"], r["copies"]) for r in df.collect()]


def plain_targets(sizes, weights, share, cap):
    left, total, fixed = dict(zip(sizes, weights)), share * sum(sizes.values()), {}
    while left:
        level = (total - sum(fixed.values())) / sum(left.values())
        full = [s for s, w in left.items() if w * level > cap * sizes[s]]
        if not full:
            return fixed | {s: w * level for s, w in left.items()}
        for s in full:
            fixed[s] = cap * sizes[s]
            del left[s]
    return fixed


def test_mix_meets_targets_and_rates_are_tilted(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(n), s) for i, (n, s) in enumerate(zip(rng.integers(1, 80, 900), rng.choice(["a", "b", "c", "d", None], 900, p=[.4, .3, .1, .1, .1])))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, word_count("text"), mixing.cyclic_weights((5.0, 2.0, 1.0)))
    found = mix_rows(mixed)
    assert sorted(found) == sorted(mix_rows(mixing.mix(docs.repartition(3), word_count("text"), mixing.cyclic_weights((5.0, 2.0, 1.0)))))
    source, sizes = {i: s for i, _, s in rows}, defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = plain_targets({s: sizes[s] for s in order}, [[5, 2, 1][k % 3] for k in range(len(order))], 1.5, 2)
    taken = defaultdict(int)
    for i, size, source_size, target, copies in found:
        assert 0 <= copies <= 2 and source_size == sizes[source[i]] and target == pytest.approx(wanted[source[i]])
        taken[source[i]] += size * copies
    for s in order:
        assert abs(taken[s] - wanted[s]) <= max(0.01 * wanted[s], 80)
    assert mixing.repeated(mixed).count() == sum(r[4] for r in found)


def test_multipliers_solve_the_dual(spark):
    rows = [("=a", n, c) for n, c in ((1, 5), (4, 9), (9, 3), (30, 2), (400, 1))] + [("=b", 10, 7), ("=c", 3, 4), ("=c", 8, 2)]
    histogram = spark.createDataFrame(rows, "key string, size long, n long")
    total = {k: sum(s * n for q, s, n in rows if q == k) for k in ("=a", "=b", "=c")}
    wanted = {"=a": 0.05 * total["=a"], "=b": 1.7 * total["=b"], "=c": 2.0 * total["=c"]}
    targets = spark.createDataFrame([(k, total[k], wanted[k]) for k in total], "key string, source_size long, target double")
    for r in mixing.multipliers(histogram, targets, 2.0).collect():
        got = sum(n * s * min(2.0, math.exp(min(r["l"] * s / r["mean"], 1))) for k, s, n in rows if k == r["key"])
        assert got == pytest.approx(wanted[r["key"]], rel=1e-6)


def test_mix_of_messy_rows(spark, messy, no_docs):
    mixed = mixing.mix(messy, word_count("text"), mixing.cyclic_weights((5.0, 2.0, 1.0)))
    found = mix_rows(mixed)
    assert len(found) == messy.count() and all(r[1] == 0 and r[4] == 1 for r in found if r[0] in (20, 21, 22))
    assert mixing.repeated(mixed).columns == messy.columns
    assert mixing.mix(no_docs, word_count("text"), mixing.cyclic_weights((5.0, 2.0))).count() == 0
    empty = messy.filter("doc_id in (20, 21, 22)")
    assert [r[4] for r in mix_rows(mixing.mix(empty, word_count("text"), mixing.cyclic_weights((1.0,))))] == [1, 1, 1]


def test_a_size_with_very_many_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'x y z' AS text", "IF(id % 10 = 0, 'b', 'a') AS source")
    found = mix_rows(mixing.mix(docs, word_count("text"), mixing.cyclic_weights((1.0, 5.0))))
    taken = Counter()
    for i, size, _, target, copies in found:
        taken[i % 10 == 0, target] += size * copies
    for (_, target), n in taken.items():
        assert abs(n - target) < 0.02 * target + 3


# ---------------------------------------------------------------------- packing

def best_by_trial(lengths, counts, buckets):
    least = None
    for cut in itertools.chain.from_iterable(itertools.combinations(range(len(lengths) - 1), k) for k in range(buckets)):
        ends, start, cost = [*cut, len(lengths) - 1], 0, 0
        for e in ends:
            cost += lengths[e] * sum(counts[start:e + 1])
            start = e + 1
        least = cost if least is None else min(least, cost)
    return least


def test_borders_are_optimal():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n = int(rng.integers(1, 11))
        lengths, counts = np.sort(rng.choice(200, n, replace=False)), rng.integers(1, 30, n)
        for buckets in (1, 2, 4, 12):
            borders, cost = packing.best_borders(lengths, counts, buckets)
            assert cost == best_by_trial(lengths.tolist(), counts.tolist(), buckets) and len(borders) <= buckets and borders[-1] == lengths[-1]
            assert cost == sum(int(c) * min(b for b in borders if b >= v) for v, c in zip(lengths, counts))


def test_batches_hold_their_budget(spark, messy, no_docs):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(977)) + F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7)).alias("n"))
    rows = packing.pack(docs, F.col("n"), budget=2000, buckets=8).collect()
    assert {r["id"]: r["length"] for r in rows} == {r["doc_id"]: r["n"] for r in docs.collect()}
    batches = defaultdict(list)
    for r in rows:
        assert r["length"] <= r["pad_to"]
        batches[r["bucket"], r["batch"]].append((r["place"], r["pad_to"]))
    last = {b: max(k for c, k in batches if c == b) for b, _ in batches}
    for (bucket, batch), found in batches.items():
        holds = max(1, 2000 // found[0][1])
        assert sorted(p for p, _ in found) == list(range(len(found))) and len(found) <= holds
        assert batch == last[bucket] or len(found) == holds
    found = packing.pack(messy, word_count("text"), budget=100, buckets=3).collect()
    assert len(found) == messy.count() and max(r["length"] for r in found) == 60_000
    assert packing.pack(no_docs, word_count("text")).count() == 0


def test_long_lengths_share_cells(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2047, 2048, 2049, 2050, 5001, 10 ** 9 + 1)], "n long")
    cells = [(r["n"], r["cell"]) for r in rows.select("n", packing.cell_of(F.col("n")).alias("cell")).collect()]
    assert all(n <= c <= n * 1.001 + 1 for n, c in cells) and [c for n, c in cells if n <= 2048] == [0, 1, 2047, 2048]


def test_long_rows_are_padded_to_the_longest_of_their_bucket(spark):
    docs = spark.createDataFrame([(i, n) for i, n in enumerate((5, 7, 2049, 2049, 5001, 5002, 70_001))], "doc_id long, n long")
    for buckets in (1, 3, 8):
        longest, pads = defaultdict(int), {}
        for r in packing.pack(docs, F.col("n"), budget=6000, buckets=buckets).collect():
            longest[r["bucket"]] = max(longest[r["bucket"]], r["length"])
            pads[r["bucket"]] = r["pad_to"]
        assert pads == longest


# --------------------------------------------------------- pipeline and queries

def test_pipeline_keeps_columns_and_handles_messy_rows(spark, messy):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(messy.select("doc_id", "text", "lang", "source", "n_chars"))
    assert labels.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        docs = kept.cache()
        assert docs.count() > 100
    packed = corpus_pipeline.pack_batches(spark, docs, SF)
    assert packed.count() == docs.count()
    docs.unpersist()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
