import numpy as np
import pandas as pd
import pytest

from gleanset.operators import budget, coreset, encode, noise, quality, sample, scoring, select, stats, trees
from gleanset.operators.distance import nearest, nearest_k


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, 120)
    x = rng.standard_normal((120, 4)) + np.eye(3, 4)[label] * 2
    rows = [(int(i), [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame(rows, "row_id bigint, features array<double>, label int")


def arrays(df):
    p = df.orderBy("row_id").toPandas()
    return np.stack(p.features), p.label.to_numpy(), p.row_id.to_numpy()


def test_allocation():
    assert budget.allocation({0: 5, 1: 3, 2: 0}, 3, 0.5) == {0: 3, 1: 1, 2: 0}
    assert sum(budget.allocation({0: 70, 1: 20, 2: 10}, 3, 0.1).values()) == 10
    assert budget.allocation({0: 4, 1: 4}, 2, 0.1, size=1) == {0: 1, 1: 1}
    assert budget.allocation({}, 2, 0.5) == {0: 0, 1: 0}
    assert [budget.subset_size(n, 0.1) for n in (5, 15, 25, 0)] == [1, 2, 2, 0]


def test_topk_skips_non_finite_scores(spark):
    rows = [(1, 0, float("nan")), (2, 0, 5.0), (3, 0, 1.0), (4, 1, float("inf")), (5, 1, None)]
    got = budget.classwise_topk(spark.createDataFrame(rows, "row_id bigint, label int, s double"), "s", 2, 0.4).collect()
    assert sorted((r.row_id, r.sample_weight) for r in got) == [(2, 3.0), (4, 2.0)]


def test_samples_have_exact_sizes(points):
    assert sample.exact_sample(points, "row_id", 17, 1).count() == 17
    ranks = sorted(r["rank"] for r in sample.global_rank(points, "row_id", 5).collect())
    assert ranks == list(range(1, 121))
    split = sample.stratified_split(points, "label", "row_id").groupBy("label", "split").count().toPandas()
    n = split.groupby("label")["count"].sum()
    for c in n.index:
        assert split[(split.label == c) & (split.split == "train")]["count"].iloc[0] == int(0.8 * n[c])


@pytest.mark.parametrize("shift", [False, True])
def test_noise_is_valid(points, shift):
    noisy = (noise.shift_noise if shift else noise.random_noise)(points, 0.2, 3)
    assert set(noise.validate(noisy, 0.2, 3, shift=shift).first()) == {0}
    assert noise.error_counts(454, 0.2) == (36, 36, 19) and noise.error_counts(1097, 0.2) == (88, 88, 43)
    assert noise.most_corrupted(30, 0.3) == 9


def test_centroid_scores_and_gradients(points):
    x, y, _ = arrays(points)
    m = scoring.Centroid.fit(points, 3, 1.5)
    assert np.allclose([list(v) for v in m.means], [x[y == c].mean(0) for c in range(3)])
    q = np.eye(3)[y]
    loss = lambda v: -(q * np.log(m.probs(v))).sum(1)
    d = np.zeros_like(x)
    d[:, 1] = 1e-6
    numeric = (loss(x + d) - loss(x - d)) / 2e-6
    got = np.stack(scoring.input_gradients(points, [m]).orderBy("row_id").toPandas().gradient)
    assert np.allclose(got[:, 1], numeric, atol=1e-5)


def test_nearest_in_blocks(points, monkeypatch):
    x, _, ids = arrays(points)
    d = ((x[:, None] - x[None, ::9]) ** 2).sum(2)
    monkeypatch.setattr("gleanset.operators.distance.MOST_VALUES", 12)
    got = nearest(points, points.where("row_id % 9 = 0")).orderBy("row_id").toPandas()
    assert (got.rep_id.to_numpy() == ids[::9][d.argmin(1)]).all() and np.allclose(got.d2, d.min(1))
    near = nearest_k(points.where("row_id < 5"), points, 4).orderBy("row_id").toPandas()
    full = ((x[:5, None] - x[None]) ** 2).sum(2)
    full[np.arange(5), np.arange(5)] = np.inf
    assert [[n["row_id"] for n in v] for v in near.neighbours] == np.argsort(full, 1)[:, :4].tolist()


def test_kernels():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 3))
    assert sorted(select.herding_order(x, 30)) == list(range(30))
    picks = select.coverage(x, np.ones(30), 5)
    assert picks[0] == ((x[:, None] - x[None]) ** 2).sum(2).sum(0).argmin() and len(set(picks)) == 5
    far = select.farthest_first(x, 4)
    assert far[0] == (x**2).sum(1).argmax() and far[1] == ((x - x[far[0]]) ** 2).sum(1).argmax()
    support, w = select.orthogonal_pursuit(x, x[3] * 2 + x[7], 2)
    assert set(support) == {3, 7} or len(support) == 2
    assert (w > 0).all() and select.orthogonal_pursuit(x, x.sum(0), 40)[0] == list(range(30))
    _, w = select.matching_pursuit(x, 6)
    assert np.isclose(w.sum(), 6) and (w > 0).all()
    assert select.expected_subset(x, np.zeros(30), 3)[0] == 0


def test_distributed_herding_agrees(points, monkeypatch):
    want = sorted(map(tuple, select.herding(points, 3, 0.05).collect()))
    monkeypatch.setattr(select, "MOST_ROWS", 1)
    assert sorted(map(tuple, select.herding(points, 3, 0.05).collect())) == want


def test_label_issues_find_flips(points):
    flipped = points.selectExpr("row_id", "features", "CASE WHEN row_id % 10 = 0 THEN (label + 1) % 3 ELSE label END AS label")
    found = {r.row_id for r in quality.centroid_cleaning(flipped, 3).collect()}
    assert len([i for i in found if i % 10 == 0]) >= 7
    kept = quality.apply_action(flipped, quality.centroid_cleaning(flipped, 3), "remove")
    assert kept.count() == 120 - len(found)


def test_methods_and_evaluation(points):
    with pytest.raises(KeyError):
        coreset.method("nothing")
    got = coreset.run(points, "deepfool", 3, 0.2).toPandas()
    assert len(got) == 24 and got.row_id.is_unique
    core = points.withColumnRenamed("label", "label").selectExpr("row_id", "features", "label", "1.0D AS sample_weight")
    scores = coreset.evaluate(core, points, 3, epochs=60)
    assert scores["accuracy"] > 0.7 and scores["n_train_selected"] == 120


def test_two_means_and_early_stop(spark):
    df = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate([1, 2, 1.5, 9, 10])], "row_id bigint, g int, v double")
    assert [r.high for r in quality.split_in_two(df, ["g"], "v").orderBy("row_id").collect()] == [False, False, False, True, True]
    curve = spark.createDataFrame([(1, e, v) for e, v in enumerate([5.0, 4.0, 4.0, 4.0, 1.0])], "k int, e int, l double")
    assert tuple(stats.early_stop(curve, "k", "e", "l", 2).first()) == (1, 4.0, 4)


def test_pure_groups(spark):
    rows = [(1, 0, [1, 1]), (2, 0, [1, 2]), (3, 1, [2, 1]), (4, 0, [2, 1]), (5, 1, [2, 2]), (6, 1, [2, 2])]
    df = spark.createDataFrame(rows, "row_id bigint, label int, leaves array<int>")
    assert sorted(map(tuple, trees.pure_groups(df, 2).collect())) == [(0, "1", 0, 2), (1, "2_2", 1, 2)]
    assert trees.leaf_scores(df, 1).where("row_id = 1").first().score == pytest.approx(0.25 * 0.5 + 2 * 0.5)
    assert isinstance(encode.standardise(spark.createDataFrame([(1, [2.0, 3.0], 0)], "row_id bigint, features array<double>, label int")).toPandas(), pd.DataFrame)


def test_recent_drops(spark):
    curves = {1: [10, 9, 8.99, 8.98, 8.97, 1], 2: [10, 9.99, 9.98, 8, 7.99, 7.98, 7.97, 0], 3: [5], 4: [3, 2, 1], 5: [2, 3, 4, 5, 1], 6: [0, 0, 0, 0]}
    df = spark.createDataFrame([(k, e, float(v)) for k, c in curves.items() for e, v in enumerate(c)], "k long, e int, l double").repartition(3)
    want = {}
    for k, c in curves.items():
        n = next((t + 1 for t in range(3, len(c)) if all(c[i - 1] - c[i] <= 0.01 * max(c[0], 1e-12) for i in range(t - 2, t + 1))), None)
        want[k] = (min(c[: n or len(c)]), n or len(c), n is not None)
    assert {r.k: (r.best_loss, r.steps, r.stopped) for r in stats.recent_drop_stop(df, "k", "e", "l", 3, 0.01).collect()} == want
    assert {k for k, v in want.items() if v[2]} == {1, 2, 5, 6}


def test_a_stage_repairs_all_detected_rows(spark):
    """A fifth of the rows lies at the boundary by their first column; none of them has another label to take."""
    n = 1500
    y = np.arange(n) % 2
    x = np.random.default_rng(4).standard_normal((n, 4)) * 0.1
    x[:, 0] += np.where(np.arange(n) < n // 5, 0.1, 1.0) * (2 * y - 1)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "row_id bigint, features array<double>, label int")
    config = coreset.Config(dirty_std=1.0, tau=1.0)
    state, report = coreset.stage(coreset.first_state(rows), 2, 1, config)
    moved = state.join(rows.withColumnRenamed("features", "old"), "row_id").where("features <> old").select("row_id").collect()
    assert report["dirty"] == n // 5 and report["repaired"] > 250 and len(moved) == report["repaired"] and max(r.row_id for r in moved) < n // 5


def test_rows_are_repaired_each_by_itself(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist(), np.eye(3)[i % 3].tolist(), [0, 4, 5][: 1 + i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, features array<double>, target array<double>, core array<int>").coalesce(1)
    models = [scoring.Mlp(6, 3, (8,), seed=k) for k in range(2)]
    config = coreset.Config(step=0.3)
    together = {r.row_id: (r.repaired, r.gain) for r in coreset.repaired_features(df, models, config).collect()}
    alone = {i: coreset.repaired_features(df.where(f"row_id = {i}"), models, config).first() for i in range(0, 40, 7)}
    assert all(together[i][0] == pytest.approx(r.repaired) and together[i][1] == pytest.approx(r.gain) for i, r in alone.items())
    for i, x, q, core in rows:
        x, q, best = np.array(x), np.array(q), together[i][0]
        loss = lambda v: float(np.mean([-(q * np.log(m.probs(np.array(v)[None])[0])).sum() for m in models]))  # noqa: B023, E731
        assert together[i][1] == pytest.approx((loss(x) - loss(best)) / loss(x)) and np.array_equal(np.delete(best, core), np.delete(x, core))
    assert min(g for _, g in together.values()) >= 0 and max(g for _, g in together.values()) > 0.3
