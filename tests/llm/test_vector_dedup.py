import numpy as np
import pytest

from brickledger.llm import vector_dedup as D
from brickledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, id int, node string, copies int, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [x if x is None else float(x) for x in v], label, 1, "n", 2, 3) for i, v, label in rows], SCHEMA)


def plain(rows, similarity):
    """Sorted (id, links, component, kept) by all pairs and union-find."""
    there = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and len(v)
             and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[k][1]) for k in there), default=0)
    x = np.array([np.pad(np.array(rows[k][1], float), (0, width - len(rows[k][1]))) for k in there]).reshape(len(there), width)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([rows[k][2] for k in there])
    linked = (x @ x.T >= similarity) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    root = np.arange(len(there))
    while True:
        new = np.array([min(root[k], root[linked[k]].min(initial=root[k])) for k in range(len(there))], int)
        if (new == root).all():
            break
        root = new
    ids = np.array([rows[k][0] for k in there])
    found = {k: (rows[k][0], int(linked[n].sum()), int(ids[root == root[n]].min())) for n, k in enumerate(there)}
    made = [found.get(k, (rows[k][0], 0, rows[k][0])) for k in range(len(rows))]
    return sorted(((*m, m[0] == m[2]) for m in made), key=str)


def found(df):
    return sorted(map(tuple, df.select("id", "n_links", "component", "kept").collect()), key=str)


def clusters(seed, n, width, spread, size):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // size, width))
    return [(i, centres[i % len(centres)] + rng.standard_normal(width) * spread * rng.random(), int(i % len(centres) % 3)) for i in range(n)]


def small(monkeypatch, **values):
    for name, value in values.items():
        monkeypatch.setattr(D, name, value)


def test_messy_vectors(spark):
    rows = [(i, np.random.default_rng(i % 20).integers(-2, 3, 5), i % 2) for i in range(60)]
    rows += [(100, [0] * 5, 1), (101, None, 1), (102, [1, None], 1), (103, [float("nan")], 1), (104, [float("inf"), 1], 1), (None, [1, 2, 3, 4, 5], 1), (105, [], 1),
             (106, [1, 2, 3, 4, 5], None), (107, [2, 1], 0), (108, [4, 2, 0, 0, 0], 0), (3, rows[3][1], 1), (3, rows[3][1], 1), (3, [9, 9, 9, 9, 1], 0),
             (-5, [1e300, 2e300], 2), (-4, [1e-300, 2e-300], 2), (None, None, None)]
    assert found(D.near_copies(table(spark, rows))) == plain(rows, 0.93)


def test_none_and_one(spark):
    assert D.near_copies(table(spark, [])).count() == 0
    assert found(D.near_copies(table(spark, [(1, None, 1), (2, [], None)]))) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert found(D.near_copies(table(spark, [(4, [1, 0], 1)]))) == [(4, 0, 4, True)]


@pytest.mark.parametrize("spread, width", [(0.15, 24), (0.4, 24), (0.6, 10), (0.05, 70)])
def test_clusters_in_many_lists_and_blocks(spark, monkeypatch, spread, width):
    small(monkeypatch, ROWS_PER_LIST=40, BLOCK=64, CHUNK=16, SAMPLE_ROWS=600)
    rows = clusters(int(spread * 100), 1500, width, spread, 60)
    rows += [(5000 + i, rows[7][1], rows[7][2]) for i in range(200)] + [(6000 + i, rows[8][1] * 3, rows[8][2]) for i in range(50)]
    got = found(D.near_copies(table(spark, rows), rows_per_task=50))
    assert got == plain(rows, 0.93) and sum(g[1] for g in got) > 1000


def test_a_dense_spot_is_counted_as_a_whole(spark, monkeypatch):
    small(monkeypatch, ROWS_PER_LIST=100, SAMPLE_ROWS=400)
    rng = np.random.default_rng(7)
    middle = rng.standard_normal(32)
    rows = [(i, middle + rng.standard_normal(32) * 0.05, 1) for i in range(900)] + [(1000 + i, middle + rng.standard_normal(32) * 0.3, 1) for i in range(300)]
    rows += [(2000 + i, rng.standard_normal(32), 1) for i in range(300)]
    assert found(D.near_copies(table(spark, rows))) == plain(rows, 0.93)
    unit = D.unit_rows(np.array([v for _, v, _ in rows]))
    index = D.fit(unit[:400], np.ones(400, int), 4, 0.93)
    home, angle = index.home(unit, np.ones(len(unit), int))
    assert len(index.hubs) >= 1 and (home[:900] >= len(index.centres)).mean() > 0.9 and angle.max() <= index.reach / 2


def test_codes_and_planes_rule_out_nothing_within_reach():
    rows = clusters(9, 1200, 16, 0.4, 40)
    unit = D.unit_rows(np.array([v for _, v, _ in rows]))
    index = D.fit(unit[:500], np.zeros(500, int), 12, 0.93)
    at = D.nearest(unit, index.centres)
    codes, base, error = index.encode(unit, at)
    close = unit @ unit.T >= 0.93
    for c in range(len(index.centres)):
        held = np.flatnonzero(at == c)
        far = np.sqrt(np.maximum(index.squared_distances(unit, index.centres[c], codes[held], base[held]), 0))
        assert (far - error[held] <= np.sqrt(2 - 2 * 0.93) + 1e-4)[close[:, held]].all()
    assert (np.sqrt(index.squared_distances(unit, index.centres[0], codes[at == 0], base[at == 0])) - error[at == 0] > np.sqrt(0.14)).mean() > 0.3


def test_registered_query_against_all_pairs(spark, tmp_path):
    got = QUERIES["op13_embedding_near_dedup"](spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    source = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == plain(source, 0.93)
    linked = clusters(11, 600, 20, 0.3, 30)
    table(spark, linked).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, QUERIES["op13_embedding_near_dedup"](spark, str(tmp_path)).collect()), key=str) == plain(linked, 0.93)
