import hashlib

import numpy as np

from gleanset.operators import kmeans, quality


def order(i, salt):
    return hashlib.md5(f"{i}|{salt}".encode()).hexdigest()


def brute(rows, k, restarts, iterations):
    """rows: group -> {id: vector}; ids by cluster of the best restart."""
    out = {}
    for members in rows.values():
        ids = sorted(members)
        x, best = np.array([members[i] for i in ids]), (np.inf, None)
        for t in range(restarts):
            c = np.array([members[i] for i in sorted(ids, key=lambda i: (order(i, f"kmeans{t}"), i))[:k]])  # noqa: B023
            for _ in range(iterations):
                at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
                c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
            d = ((x[:, None] - c) ** 2).sum(2)
            if round(d.min(1).sum(), 9) < best[0]:
                best = (round(d.min(1).sum(), 9), d.argmin(1))
        out |= dict(zip(ids, best[1].tolist(), strict=True))
    return out


def test_lloyd_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = {0: {i: rng.normal(size=3) + (i % 3) * 2 for i in range(60)}, 7: {i: rng.normal(size=3) for i in range(100, 102)}, -2: {200: rng.normal(size=3)}, 5: {i: np.ones(3) for i in range(300, 330)}}
    df = spark.createDataFrame([(i, g, v.tolist(), "x") for g, m in rows.items() for i, v in m.items()], "row_id long, group long, v array<double>, far string").repartition(5)
    for restarts, iterations in ((1, 2), (4, 30)):
        got = kmeans.clustered(df, 3, restarts, iterations).collect()
        assert {r.row_id: r.cluster for r in got} == brute(rows, 3, restarts, iterations) and got[0].far == "x"
    assert kmeans.clustered(df.where("false"), 3).count() == 0


def test_votes_of_clusters(spark):
    """Rows whose losses stay high are in the clusters of large areas, in every class and window."""
    rng = np.random.default_rng(4)
    level = {i: [0.1, 1.0, 3.0][i % 3] if i != 99 else 9.0 for i in range(100)}
    curves = [(i, 9 if i == 99 else i % 2, e, float(v + rng.random() * 0.05)) for i, v in level.items() for e in range(12 if i != 50 else 4)]
    df = spark.createDataFrame(curves, "row_id long, label int, epoch int, loss double")
    got = {r.row_id: (r.clean_votes, r.noisy) for r in quality.ctrl_clusters(df, 12, 3, 2.0, clusters=3, noisy_clusters=2).collect()}
    assert {i for i, (_, noisy) in got.items() if not noisy} == {i for i, v in level.items() if v == 0.1 or i == 99}
    assert got[99] == (3, False) and got[50][0] <= 1  # alone in its class; of one window only
    one = {r.row_id for r in quality.ctrl_clusters(df, 12, 1, 1.0, clusters=3, noisy_clusters=1).where("noisy").collect()}
    assert one == {i for i, v in level.items() if v == 3.0 and i != 50}
