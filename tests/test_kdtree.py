import numpy as np
import pytest

from gleanset.operators import kdtree, neighbours
from gleanset.operators.distance import nearest

KIND = "row_id bigint, features array<double>, label int, block string"


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, v.tolist(), 0, "x") for i, v in enumerate(x)], KIND).repartition(3)


def brute(y, ids, v, leaf):
    """One descent, split anew on the way."""
    rows = sorted(range(len(y)), key=lambda i: ids[i])
    while len(rows) > leaf and (spread := y[rows].var(0)).max() > 1e-12:
        dim = int(spread.argmax())
        rows.sort(key=lambda i: (y[i][dim], ids[i]))
        half = len(rows) // 2
        rows = rows[:half] if v[dim] <= y[rows[half]][dim] else rows[half:]
    return min((float(((v - y[i]) ** 2).sum()), ids[i]) for i in rows)


@pytest.mark.parametrize("shape", ["normal", "ties", "copies"])
def test_descent_against_brute_force(spark, monkeypatch, shape):
    rng = np.random.default_rng(9)
    y = {"normal": rng.normal(size=(150, 3)) * [1, 5, 2], "ties": rng.integers(0, 3, size=(150, 3)).astype(float), "copies": np.tile(rng.normal(size=3), (150, 1))}[shape]
    x = np.concatenate([y[:40], rng.normal(size=(80, 3)) * 2])
    ids = [1000 + i for i in range(150)]
    want = [brute(y, ids, v, 8) for v in x]
    points, reps = table(spark, x), table(spark, y, 1000)
    for most in (1 << 20, 20 * 3):  # one tree; upper levels in Spark
        monkeypatch.setattr(kdtree, "MOST_VALUES", most)
        monkeypatch.setattr(neighbours, "VISITORS", 16)
        got = kdtree.kd_nearest(points, reps, 8).orderBy("row_id").collect()
        assert [r.rep_id for r in got] == [i for _, i in want] and np.allclose([r.d2 for r in got], [d for d, _ in want]) and got[0].block == "x"
    assert {(r.rep_id, r.d2) for r in kdtree.kd_nearest(points, reps.where("false")).collect()} == {(None, None)}
    assert kdtree.kd_nearest(points.where("false"), reps).count() == 0


def test_agreement_with_exact_neighbours(spark):
    """In few dimensions one descent finds the nearest mostly, and never anything nearer than that."""
    rng = np.random.default_rng(10)
    points, reps = table(spark, rng.normal(size=(2000, 2))), table(spark, rng.normal(size=(2000, 2)), 5000)
    both = kdtree.kd_nearest(points, reps).join(nearest(points, reps).selectExpr("row_id", "rep_id AS best", "d2 AS least"), "row_id").collect()
    assert len(both) == 2000 and all(r.d2 >= r.least - 1e-12 for r in both)
    assert np.mean([r.rep_id == r.best for r in both]) > 0.75
