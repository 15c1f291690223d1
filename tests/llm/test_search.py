import numpy as np
import pytest
from pyspark.sql import functions as F

from brickledger.llm import ann, exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, part int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [x if x is None else float(x) for x in v], 1, 0.0, 1, 2) for i, v in vectors], SCHEMA)


def messy_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 6)) for i in range(60)]
    rows += [(100, [0] * 6), (101, None), (102, [1, None, 2, 0, 0, 0]), (103, [float("nan")] * 6), (104, [float("inf")] + [1] * 5), (None, [1] * 6),
             (105, []), (106, [2, 1]), (107, [1, 1, 1, 1, 1, 1, 1, 9])]
    return rows + [(7, rows[7][1]), (110, rows[7][1]), (111, rows[7][1])]  # repeated row, equal vectors


def usable(vectors, zero_too):
    kept = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not zero_too and not any(v):
            continue
        kept.setdefault(i, []).append(np.pad(np.array(v, float), (0, 8 - len(v))))
    return kept


def brute(vectors, score, zero_too, every=5, k=5):
    kept = usable(vectors, zero_too)
    rows = [(i, v) for i, vs in kept.items() for v in vs]
    found = {}
    for q in kept:
        if q % every == 0:
            ranked = sorted(((-score(kept[q][0], v), i) for i, v in rows if i != q))[:k]
            found[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return found


def lists(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    return found


def test_exact_top_k_against_brute_force(spark):
    rows = messy_vectors()
    found = lists(exact_topk.top_k(table(spark, rows), F.col("id") % 5 == 0, k=5, factor=256))
    assert found == brute(rows, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)), True)


def test_exact_top_k_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).astype(np.float32)) for i in range(90)]
    found = lists(exact_topk.top_k(table(spark, rows), F.col("id") % 5 == 0, k=3))
    assert found == brute(rows, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)), True, k=3)


def test_wide_scores_are_exact_or_an_error(spark):
    big = float(2 ** 32)
    rows = [(0, [big, big, 0.0]), (5, [big, -big, 1.0]), (6, [0.0, 1.0, 1.0]), (7, [1.0, 0.0, -1.0])]
    found = lists(exact_topk.top_k(table(spark, rows), F.col("id") % 5 == 0, k=3))
    assert found == {0: [(1, 6, 2 ** 48), (2, 7, 2 ** 48), (3, 5, 0)], 5: [(1, 7, 2 ** 48 - 2 ** 16), (2, 0, 0), (3, 6, 2 ** 16 - 2 ** 48)]}
    for bad in ([big, big, 0.0], [1e30, 0.0, 0.0], [-3e38]):
        with pytest.raises(Exception, match="64-bit"):
            exact_topk.top_k(table(spark, [*rows, (8, bad)]), F.col("id") % 5 == 0).collect()


def test_few_and_no_vectors(spark):
    two = table(spark, [(0, [1, 0]), (1, [0, 1])])
    assert lists(exact_topk.top_k(two, F.col("id") % 5 == 0)) == {0: [(1, 1, 0)]}
    assert lists(ann.nearest(two, F.col("id") % 5 == 0)) == {0: [(1, 1, 0.0)]}
    none = table(spark, [])
    assert exact_topk.top_k(none, F.col("id") % 5 == 0).count() == 0
    assert ann.nearest(none, F.col("id") % 5 == 0).count() == 0


def test_neighbours_of_a_small_table_are_exact(spark):
    rows = messy_vectors()
    found = lists(ann.nearest(table(spark, rows), F.col("id") % 5 == 0))
    unit = lambda v: v / np.linalg.norm(v)
    wanted = brute(rows, lambda a, b: round(float(unit(a) @ unit(b)), 9), False)
    assert {q: [(r, i, round(s, 9) + 0.0) for r, i, s in found[q]] for q in found}.keys() == wanted.keys()
    for q in wanted:
        assert [s for _, _, s in wanted[q]] == pytest.approx([s for _, _, s in found[q]], abs=1e-9)
        assert len({i for _, i, _ in found[q]} - {q}) >= len({i for _, i, _ in wanted[q]}) - 1


def test_recall_with_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_PART", 64)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 200)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16)) * 2
    rows = [(i, centres[i % 20] + rng.standard_normal(16)) for i in range(2000)]
    found = lists(ann.nearest(table(spark, rows), F.col("id") % 20 == 0, sample_rows=1000))
    x = np.stack([np.array(v, np.float32).astype(float) for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 2000, 20):
        close = x @ x[q]
        close[q] = -9
        hits += len(set(np.argsort(-close)[:5].tolist()) & {i for _, i, _ in found[q]})
        assert [s for _, _, s in found[q]] == pytest.approx([close[i] for _, i, _ in found[q]])
    assert hits / 500 >= 0.9


def test_partitions_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((4, 8)) * 5, 50, axis=0) + rng.standard_normal((200, 8))
    near = ann.neighbour_graph(ann.unit_rows(x), 5)
    part = ann.balanced_parts(near, 4)
    assert np.bincount(part).tolist() == [50, 50, 50, 50]
    assert (part[near] == part[:, None]).mean() > 0.9
