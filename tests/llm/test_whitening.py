from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickledger.llm import whitening
from brickledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, x int, component string, n string, `a.b` int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [e if e is None else float(e) for e in v], 1, 2, "c", "n", 3) for i, v in vectors], SCHEMA)


def grid(v, width):
    return [int(np.floor(64 * e)) + 1_000_000 for e in [*v, *[0.0] * (width - len(v))]]


def plain(vectors, width):
    """Ids, exact integer entries, deviations and covariance by fractions."""
    rows = [(i, grid(v, width)) for i, v in vectors if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    n = len(rows)
    sums = [sum(x[j] for _, x in rows) for j in range(width)]
    cov = np.array([[float(sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for _, x in rows) / n)
                     for j in range(width)] for i in range(width)])
    deviations = [sum((n * x[j] - sums[j]) ** 2 for j in range(width)) for _, x in rows]
    return rows, n, sums, cov, deviations


def check(found, vectors, width, components):
    rows, n, sums, cov, deviations = plain(vectors, width)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    by_component = defaultdict(list)
    for r in found:
        by_component[r["component"]].append(r)
    assert sorted(by_component) == list(range(1, len(values) + 1))
    x = np.array([[float(Fraction(e) - Fraction(s, n)) for e, s in zip(row, sums)] for _, row in rows])
    for c, got in by_component.items():
        wanted = x @ axes[:, c - 1] / np.sqrt(values[c - 1])
        assert sorted((str(r["id"]), int(r["deviation"]), round(abs(r["whitened"]), 6)) for r in got) == sorted(
            (str(i), d, round(abs(w), 6)) for (i, _), d, w in zip(rows, deviations, wanted))
        assert all(r["n"] == n for r in got)
        assert got[0]["explained"] == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
        assert got[0]["identity_error"] < 1e-9


def test_messy_vectors_against_fractions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(5) * [5, 3, 2, 1, 0.5]) for i in range(40)]
    rows += [(50, None), (51, [1, None, 2]), (52, [float("nan")] * 5), (53, [float("inf"), 1, 1, 1, 1]), (None, [1, 2, 3, 4, 5]), (54, []), (55, [2, 1]),
             (3, rows[3][1]), (3, rows[3][1]), (56, [0] * 5)]
    check(whitening.whiten(table(spark, rows), components=3).collect(), rows, 5, 3)
    check(whitening.whiten(table(spark, rows), components=32).collect(), rows, 5, 5)


def test_entries_of_any_size_are_added_exactly(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4) * [1e12, 4e12, 2e12, 8e12]) for i in range(30)]
    check(whitening.whiten(table(spark, rows), components=4).collect(), rows, 4, 4)
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whiten(table(spark, [(1, [1e30, 1]), (2, [0, 1])])).collect()


def test_no_spread_gives_no_components(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1, 2])])).count() == 0
    assert whitening.whiten(table(spark, [(i, [1, 2]) for i in range(9)])).count() == 0
    assert whitening.whiten(table(spark, [(i, []) for i in range(3)])).count() == 0
    flat = whitening.whiten(table(spark, [(i, [i, i, 3]) for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)


def test_equal_eigenvalues_get_orthogonal_axes(spark):
    corners = [(i, [8.0 * s if j == k else 0.0 for j in range(6)]) for i, (k, s) in enumerate((k, s) for k in range(6) for s in (-1, 1))]
    found = whitening.whiten(table(spark, corners), components=4).collect()
    w = np.zeros((12, 4))
    for r in found:
        w[r["id"], r["component"] - 1] = r["whitened"]
    assert np.abs(w.T @ w / 12 - w.mean(0)[:, None] * w.mean(0) - np.eye(4)).max() < 1e-10
    assert {round(r["explained"], 9) for r in found} == {round(1 / 6, 9)} and found[0]["identity_error"] < 1e-10


def test_counts_by_pivots_are_those_of_the_spectrum():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 40):
        for _ in range(20):
            a = rng.integers(-3, 4, (n, n)).astype(float)
            a = a + a.T
            values = np.linalg.eigvalsh(a)
            for shift in rng.uniform(values[0] - 1, values[-1] + 1, 5):
                assert whitening.count_above(a, shift) == (values > shift).sum()
    assert whitening.count_above(np.array([[0.0, 1], [1, 0]]), 0.0) == 1 and whitening.count_above(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("values", [
    np.geomspace(1, 1e-9, 30), np.r_[[5.0] * 4, [5 - 1e-13] * 3, 1 + np.arange(20) * 1e-12, [0] * 3], np.arange(30.0), np.r_[1.0, [0.5] * 29]])
def test_leading_pairs_of_hard_spectra(values):
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((len(values), len(values))))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, axes = whitening.leading(a, 12)
    wanted = np.sort(values)[::-1][:12]
    assert np.abs(found - wanted).max() < 1e-13 * 30 * wanted[0]
    assert np.abs(axes.T @ axes - np.eye(12)).max() < 1e-13
    assert np.abs(a @ axes - axes * found).max() < 1e-12 * wanted[0]
    assert len(whitening.slices(a, 12)) <= 12


def test_registered_query_against_fractions(spark):
    got = QUERIES["op11_embedding_whitening"](spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
    source = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([grid(r["embedding"], 64) for r in source], dtype=object)
    n, sums = len(x), x.sum(0)
    deviations = ((n * x - sums) ** 2).sum(1)
    centred = ((n * x - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    whitened = centred @ axes[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    place = {r["vec_id"]: k for k, r in enumerate(source)}
    rows = got.collect()
    assert len(rows) == 32 * n and len({(r["vec_id"], r["component"]) for r in rows}) == 32 * n
    sign = np.zeros(33)
    for r in rows:
        k, c = place[r["vec_id"]], r["component"]
        sign[c] = sign[c] or np.sign(r["whitened"]) * np.sign(whitened[k, c - 1])
        assert r["n"] == n and r["deviation"] == deviations[k]
        assert r["whitened"] * sign[c] == pytest.approx(whitened[k, c - 1], abs=1e-8)
        assert r["explained"] == pytest.approx(values[64 - c] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
    means = got.groupBy("component").agg(F.avg("whitened").alias("m"), F.avg(F.col("whitened") * F.col("whitened")).alias("v")).collect()
    assert all(abs(r["m"]) < 1e-9 and r["v"] == pytest.approx(1) for r in means)
