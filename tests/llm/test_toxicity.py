import zlib

import numpy as np
import pyarrow as pa

from gleanset.llm import toxicity as tox


def corpus(n, seed=1):
    rng = np.random.Generator(np.random.PCG64(seed))
    words = ["".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(400)]
    rows = []
    for i in range(n):
        w = rng.choice(words, rng.integers(20, 120)).tolist()
        bad = int(i % 3 == 0)
        if bad:
            for j in rng.integers(0, len(w), 2):
                w[j] = rng.choice(["idiot", "scum", "zorkling", "zorkful"])
        rows.append((i, " ".join(w), bad))
    return rows


def test_gradient_against_differences():
    vocabulary = np.sort(tox.Words(*tox.utf8(pa.array(["some words here you idiot go a b"])), tox.WORDS).hash)
    net = tox.Network.fresh(1, vocabulary)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    f = tox.features(pa.array(["some words here", "you idiot go", " a b c d e"]), vocabulary)
    doc, at, size = tox.windows(f.first, 4, 3)
    y = (doc == 1).astype(float)

    def loss():
        p = tox._sigmoid(net.forward(net.inputs(f), at, size)[0])
        return -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))

    _, g = net.gradient(f, net.inputs(f), at, size, y)
    for k in g:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        o, e = net.p[k][i], 1e-5
        net.p[k][i] = o + e
        a = loss()
        net.p[k][i] = o - e
        b = loss()
        net.p[k][i] = o
        assert abs((a - b) / (2 * e) - g[k][i]) < 0.02 * abs(g[k][i]) + 1e-5, k


def test_windows_cover_every_word():
    first = np.array([0, 0, 5, 37, 37, 137, 137 + 32])
    doc, at, size = tox.windows(first)
    covered = np.zeros(first[-1], int)
    for a, s in zip(at, size, strict=True):
        covered[a : a + s] += 1
    assert (covered > 0).all() and set(doc) == {1, 2, 4, 5}
    assert all(first[d] <= a and a + s <= first[d + 1] for d, a, s in zip(doc, at, size, strict=True))


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(900)
    extra = [(9001, None, 0), (9002, "", 0), (9003, "?!", 1), (9004, "plain " * 30_000 + "idiot scum", None), (None, "some text", 0), (5, rows[5][1], 0)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows + extra], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows + extra], "doc_id long, quality int, toxic int")
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score == by[9003].score == 0.0 and by[9004].predicted == 1
    assert all(0 <= r.score <= 1 for r in got)
    assert tox.toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in tox.toxicity(docs.limit(3), labels.limit(0)).collect()} == {0}
