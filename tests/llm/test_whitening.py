import math
import random

import numpy as np
import pytest

from gleanset.llm.whitening import primes, remaindered, whiten

KIND = "vec_id long, embedding array<double>, label int, x string, n int"


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], KIND).repartition(parts)


def brute(rows, k):
    """Exact integers, and a covariance from centred quotients of them."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    far = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[sum(r[a] * r[b] for r in y) / n**3 for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, far, (np.array(y) / n) @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_against_exact_integers(spark):
    rnd = np.random.default_rng(12)
    mix = rnd.normal(size=(6, 6)) * np.array([9, 5, 3, 1, 0.5, 0.2])
    rows = [(i, (rnd.normal(size=6) @ mix + 40).tolist()) for i in range(300)]
    rows += [(7, rows[7][1])] * 150 + [(None, rows[8][1])]  # a third are one vector
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [math.nan] + [1.0] * 5), (903, [math.inf] + [1.0] * 5), (904, [1.0]), (905, [])]
    n, far, z, share = brute(rows, 4)
    for parts in (1, 7):
        got = whiten(table(spark, rows + bad, parts), 4).collect()
        assert len(got) == len(rows) and {r.n for r in got} == {n}
        key = lambda i, v: (repr(i), v)
        got = sorted(got, key=lambda r: key(r.vec_id, r.deviation))
        want = sorted(range(n), key=lambda k: key(rows[k][0], far[k]))
        assert [(r.vec_id, r.deviation, r.deviation_text) for r in got] == [(rows[k][0], far[k], str(far[k])) for k in want]
        w = np.array([r.whitened for r in got])
        sign = np.sign((w * z[want]).sum(0))
        assert np.abs(w * sign - z[want]).max() < 1e-8
        assert np.allclose(got[0].explained, share, rtol=1e-10) and len({tuple(r.explained) for r in got}) == 1
        assert got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1
        assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9


def test_large_numbers_and_flat_vectors(spark):
    rows = [(1, [1e17, 0.0]), (2, [-1e17, 1.0]), (3, [3e300, 2.0]), (4, [5.0, -7.5])]
    got = {r.vec_id: r for r in whiten(table(spark, rows)).collect()}
    top = 2**61
    x = {i: [min(max(math.floor(64 * c) if abs(c) < 1e290 else top, -top), top) + 1_000_000 for c in v] for i, v in rows}
    s = [sum(r[j] for r in x.values()) for j in range(2)]
    for i, v in x.items():
        assert int(got[i].deviation_text) == sum((4 * v[j] - s[j]) ** 2 for j in range(2)) and got[i].deviation is None
    one = whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [([0.0, 0.0], [0.0, 0.0], 0, 0.0)]
    flat = whiten(table(spark, [(k, [float(k % 3), 5.0]) for k in range(9)])).collect()
    assert all(r.whitened[1] == 0.0 and r.explained == [1.0, 0.0] for r in flat) and flat[0].identity_error < 1e-12
    for empty in ([], [(1, None)], [(1, []), (2, [])]):
        assert whiten(table(spark, empty)).count() == 0


def test_remaindering():
    rnd = random.Random(5)
    for bits in (10, 60, 200):
        for x in [rnd.randrange(-(2**bits), 2**bits) for _ in range(50)]:
            moduli = primes(2 ** (bits + 1) + 1)
            assert remaindered([x % p for p in moduli], moduli) == x
    with pytest.raises(ValueError):
        remaindered([1, 1], [7, 7])
