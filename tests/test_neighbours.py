import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanset.operators import distance, neighbours

KIND = "row_id bigint, features array<double>, label int, neighbourhood string"


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist(), int(i) % 3, "x") for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], KIND).repartition(5)


def brute(x, ids, y, pool, k, others):
    out = {}
    for i, v in zip(ids, x, strict=True):
        d = sorted((float(((v - w) ** 2).sum()), int(j)) for j, w in zip(pool, y, strict=True) if not (others and i == j))
        out[int(i)] = d[:k]
    return out


@pytest.mark.parametrize("shape", ["clusters", "sphere", "copies", "grid"])
def test_knn_against_brute_force(spark, monkeypatch, shape):
    rng = np.random.default_rng(5)
    x = {
        "clusters": lambda: (rng.normal(size=(400, 3)) * 0.1 + rng.integers(0, 6, size=(400, 1)) * 7.0 + 1000),
        "sphere": lambda: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(300, 16))),
        "copies": lambda: np.concatenate([np.tile(rng.normal(size=4), (150, 1)), rng.normal(size=(150, 4))]),
        "grid": lambda: rng.integers(0, 4, size=(300, 2)).astype(float),
    }[shape]()
    monkeypatch.setattr(neighbours, "MOST_VALUES", 40 * x.shape[1])
    monkeypatch.setattr(neighbours, "VISITORS", 64)
    monkeypatch.setattr(neighbours, "PAIRS", 100)
    ids = np.arange(len(x)) * 3 - 50
    e = table(spark, x, ids)
    want = brute(x, ids, x, ids, 5, True)
    for r in distance.nearest_k(e, e, 5).collect():
        assert [n.row_id for n in r.neighbours] == [j for _, j in want[r.row_id]]
        assert np.allclose([n.d2 for n in r.neighbours], [d for d, _ in want[r.row_id]], rtol=1e-12)
        assert r.neighbourhood == "x" and all(n.label == n.row_id % 3 for n in r.neighbours)
    reps, own = x[::2] + 0.01, ids[::2] + 1000
    one = brute(x, ids, reps, own, 1, False)
    monkeypatch.setattr(distance, "MOST_VALUES", 10)
    got = distance.nearest(e, table(spark, reps, own)).collect()
    assert {r.row_id: r.rep_id for r in got} == {i: d[0][1] for i, d in one.items()}
    assert np.allclose([r.d2 for r in got], [one[r.row_id][0][0] for r in got])


def test_cells_are_left_out(spark, monkeypatch):
    """Far groups aren't visited: rows meet the blocks of their own group only."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3)) * 0.1 + np.arange(600)[:, None] % 12 * 50.0
    monkeypatch.setattr(neighbours, "MOST_VALUES", 50 * 3)
    pool = table(spark, x).select("row_id", "features", "label")
    cells = neighbours.fitted(pool, 3, len(x))
    n = cells.pack(50)
    d, s = cells.distances(x), cells.slack(x)
    bound = cells.bound(d, s, 4)
    visits = cells.visits(d, s, bound, cells.home(d.argmin(1), np.arange(600)))
    assert cells.rows.sum() == 600 and n >= 12 and sum(map(len, visits)) < 600 * n / 5
    truth = np.sort(((x[:, None] - x[None]) ** 2).sum(2), 1)
    assert (bound >= np.sqrt(truth[:, 3])).all()


def test_small_pools(spark):
    x = np.array([[0.0, 0], [1, 0], [5, 5]])
    e = table(spark, x)
    assert {r.row_id: [n.row_id for n in r.neighbours] for r in distance.nearest_k(e, e, 9).collect()} == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    none = distance.nearest_k(e, e.where("false"), 2)
    assert [r.neighbours for r in none.collect()] == [[]] * 3
    assert distance.nearest_k(e.where("false"), e, 2).count() == 0
    assert [(r.rep_id, r.d2) for r in distance.nearest(e, e.where("false")).collect()] == [(None, None)] * 3
    assert {r.neighbours[0].row_id for r in distance.nearest_k(e.where("row_id = 2"), e.withColumn("row_id", F.col("row_id") + 10), 1).collect()} == {12}
