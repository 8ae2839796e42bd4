import numpy as np

from gleanset.llm import language_id as lid

WORDS = {"en": "the and that with from have this which would there", "de": "der und nicht ein eine auch sich werden über können", "fr": "les des une dans pour avec être cette nous vous"}


def corpus(n):
    rng = np.random.Generator(np.random.PCG64(1))
    return [(i, " ".join(rng.choice(WORDS[k].split(), 30)), k) for i, k in enumerate(rng.choice(sorted(WORDS), n).tolist())]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "src", 5, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")


def test_vectors_are_the_bundle_of_bound_letters():
    memory = lid.item_memory(64)
    v, has = lid.encode(["Ab", "", "12 3"], memory)
    a, b, edge = memory[ord("a") + 1], memory[ord("b") + 1], memory[0]
    want = np.roll(edge, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * edge
    assert np.allclose(v[0], want / np.linalg.norm(want), atol=1e-6) and has.tolist() == [True, False, False]
    assert not v[1:].any()


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(400) + [(9001, None, "en"), (9002, "", "de"), (9003, "1234 ...", None), (None, "the and that with", "en"), (9004, "der und nicht ein " * 40_000, None), (0, corpus(1)[0][1], None)]
    got = lid.language_id(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {i: k for i, _, k in corpus(400)}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (9001, 9002, 9003)] == [("und", 0.0)] * 3
    assert by[9004].lang_pred == "de" and by[None].held_out is False and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    assert [tuple(r)[2:] for r in lid.language_id(frame(spark, [(1, "some text", None)])).collect()] == [("und", 0.0)]
    assert lid.language_id(frame(spark, [])).count() == 0


def test_sample_of_a_huge_class(spark):
    """With 5e9 rows of a class the threshold still draws some rows: about most / count of the hash's range."""
    ids = spark.range(200_000).selectExpr("id AS doc_id", "'en' AS lang")
    assert 70 < ids.where(lid.drawn("doc_id", "lang", {"en": 2_000_000_000}, {"en": 1_000_000})).count() < 130
    assert ids.where(lid.drawn("doc_id", "lang", {"en": 10}, {"en": 1000})).count() == 200_000


def test_many_letters_take_bounded_memory():
    import tracemalloc

    rng = np.random.Generator(np.random.PCG64(4))
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 700).tolist())) for _ in range(500)]
    memory = lid.item_memory(1024)
    lid.encode(["warm"], memory)
    tracemalloc.start()
    v, has = lid.encode(texts, memory)
    assert tracemalloc.get_traced_memory()[1] < 200e6 and has.all()
    tracemalloc.stop()
    one = lid.encode(texts[3:4], memory)[0]
    assert np.allclose(v[3], one[0], atol=1e-5)
