import numpy as np
import pytest

from gleanset.operators import cover, select
from gleanset.plans import queries

CLASSES = 10


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Embeddings (103 rows of 10 classes) and events (users of 3 to 45 events)."""
    d = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(6) + i % CLASSES).tolist(), i % CLASSES) for i in range(103)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    events = [(u, n, float(rng.random() + (30 - min(n, 30)) * (u % 2))) for u in range(12) for n in range(3 + (u * 17) % 43)]
    rows = [(k, u, n * 60, v) for k, (u, n, v) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, user_id long, at long, value double").selectExpr("event_id", "user_id", "timestamp_seconds(at) AS ts", "value").write.parquet(f"{d}/events.parquet")
    return str(d)


def curves(spark, folder):
    out = {}
    for r in spark.read.parquet(f"{folder}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        out.setdefault(r.user_id, []).append(r.value)
    return out


def averages(losses, window=5):
    w = min(window, len(losses))
    return [float(np.mean(losses[max(0, e + 1 - window) : e + 1])) if e >= w - 1 else float(np.mean(losses[:w])) for e in range(len(losses))]


def test_every_row_is_scored(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    x, y = np.array([r.embedding for r in rows]), np.array([r.label for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {i: round(float((y[np.argsort(d[i], kind="stable")[:7]] != y[i]).mean()), 6) for i in range(len(x))}
    assert {r.row_id: r.disagreement for r in queries.knn_label_disagreement(spark, folder).collect()} == pytest.approx(want)


def test_moving_averages_of_all_epochs(spark, folder):
    want = {(u, e): m for u, c in curves(spark, folder).items() for e, m in enumerate(averages(c))}
    got = {(r.row_id, r.epoch): r.ma for r in queries.loss_moving_average(spark, folder).collect()}
    assert max(e for _, e in got) > 19 and got == pytest.approx(want, abs=1e-6)


def test_ctrl_votes_of_all_epochs(spark, folder):
    c = curves(spark, folder)
    epochs = max(map(len, c.values()))
    edges = [int(k * epochs / 3) for k in range(4)]
    votes = dict.fromkeys(c, 0)
    for label in range(3):
        for a, b in zip(edges, edges[1:], strict=False):
            areas = sorted((sum(averages(c[u])[a:b]), u) for u in c if u % 3 == label and len(c[u]) > a)
            spread = lambda v: sum((x - np.mean([y for y, _ in v])) ** 2 for x, _ in v)
            cut = min(range(1, len(areas)), key=lambda k: (round(spread(areas[:k]) + spread(areas[k:]), 9), k), default=len(areas))  # noqa: B023
            for _, u in areas[:cut]:
                votes[u] += 1
    assert {r.row_id: (r.clean_votes, r.noisy) for r in queries.ctrl_flags(spark, folder).collect()} == {u: (v, v < 2) for u, v in votes.items()}


def test_early_stopping_looks_at_all_epochs(spark, folder):
    want = {}
    for u, losses in curves(spark, folder).items():
        best, bad, stop = float("inf"), 0, 0
        for n, x in enumerate(losses, 1):
            if x < best - 0.01:
                best, bad = x, 0
            else:
                bad += 1
            if bad >= 4:
                stop = n
                break
        want[u] = (best, stop)
    assert max(stop for _, stop in want.values()) > 20
    assert {r.row_id: (r.best_loss, r.stopped_at) for r in queries.early_stop_fold(spark, folder).collect()} == want


def test_quality_coreset_relabels(spark, monkeypatch):
    reports, loop = [], queries.coreset.quality_coreset

    def kept(points, n_classes, config):
        out = loop(points, n_classes, config)
        reports.extend(out[2])
        return out

    monkeypatch.setattr(queries.coreset, "quality_coreset", kept)
    assert queries.quality_coreset(spark, "/root/testdata/sf0.001").count() == 50
    assert len(reports) >= 3 and sum(r["relabelled"] for r in reports) > 0


def test_coverage_beyond_one_task_takes_all_candidates(spark, monkeypatch):
    rng = np.random.default_rng(2)
    g = rng.standard_normal((160, 3))
    g[100:110] = g[5]
    w = rng.integers(1, 10, 160) / 10
    points = spark.createDataFrame([(int(i) * 3, x.tolist(), float(v)) for i, x, v in zip(rng.permutation(160), g, w, strict=True)], "row_id bigint, g array<double>, w double").repartition(3, "row_id")
    for block, lazy in ((4096, 64), (50, 7)):
        monkeypatch.setattr(cover, "BLOCK", block)
        monkeypatch.setattr(cover, "LAZY", lazy)
        want = sorted(map(tuple, select.weighted_coverage(points, "g", 25, "w").collect()))
        assert len(want) == 25 and sorted(map(tuple, select.weighted_coverage(points, "g", 25, "w", most=100).collect())) == want
