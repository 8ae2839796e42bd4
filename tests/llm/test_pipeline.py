import random

import pytest

import corpus_pipeline as cp
from gleanset.llm.decontaminate import contamination, decontaminated

WORDS = {"en": "the and that with from have this which would there some other people", "de": "der und nicht ein eine auch sich werden über können mit dem das"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(6)
    rows, at = [], 0

    def text(k, n=60):
        return " ".join(rnd.choice(WORDS[k].split()) + str(rnd.randrange(500)) for _ in range(n))

    for i in range(60):
        rows.append((i, text(rnd.choice(["en", "de"])), "en"))
    items = [(k, text("en", 20)) for k in range(5)]
    rows += [(100, rows[7][1], "en"), (101, rows[7][1], "en"), (102, rows[9][1] + " tail", "en")]
    rows += [(103, text("en", 30) + " " + items[2][1] + " " + text("en", 30), "en"), (104, "123 456", "en"), (105, None, "de"), (106, "", None), (105, None, "de")]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, k, "src0", len(t or ""), 1) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return rows, items, str(d)


def test_stages(spark, tables, tmp_path):
    rows, items, d = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        if name != "tokens":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept.append({r.doc_id for r in docs.collect()})
    everything = {i for i, _, _ in rows}
    assert kept[0] == everything - {104, 105, 106}
    assert kept[1] == kept[0] - {7, 100}
    assert kept[2] == kept[1] - {102}
    assert kept[3] == kept[2] - {103}
    final = cp.run(spark, d).collect()
    assert sorted(r.doc_id for r in final) == sorted(kept[3]) and all(r.n_tokens > 0 for r in final)


def test_empty_tables(spark, tables, tmp_path):
    _, _, d = tables
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_contamination_in_blocks(spark, tables):
    _, _, d = tables
    docs, b = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    one = sorted(map(str, contamination(docs, b).collect()))
    assert one == sorted(map(str, contamination(docs, b, block_bytes=300).collect()))
    assert decontaminated(docs, b.limit(0)).count() == docs.count()


def test_near_stage_against_brute_force(spark):
    """Copies with some words changed; many pairs have a five-word similarity between 0.80 and 0.85."""
    rnd = random.Random(8)
    rows, shingles = [], {}
    for k in range(30):
        base = [f"w{rnd.randrange(5000)}" for _ in range(49)]
        for j in range(3):
            t = list(base)
            if j:
                t[rnd.randrange(49)] = f"x{k}y{j}"
            rows.append((3 * k + j, " ".join(t)))
            shingles[3 * k + j] = {tuple(t[a : a + 5]) for a in range(45)}
    rows.append((500, " ".join(["same"] * 3)))
    top = {i: i for i in shingles}
    between = 0
    for i, a in shingles.items():
        for j, b in shingles.items():
            share = len(a & b) / len(a | b)
            between += i < j and 0.8 <= share < 0.85
            if i < j and 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((top[i], top[j]))
                top = {n: x if t == y else t for n, t in top.items()}
    assert between > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in cp.unalike(spark, docs, "").collect()} == {i for i, t in top.items() if i == t} | {500}


def test_clashing_columns_pass_unchanged(spark, tmp_path):
    rnd = random.Random(4)
    text = lambda n=50: " ".join(rnd.choice(WORDS["en"].split()) + str(rnd.randrange(500)) for _ in range(n))
    names = ["__keep", "__digest", "__row", "__lang", "__cosine", "keep", "Digest", "_digest", "row", "keeper", "found_lang", "cosine", "a b", "n"]
    rows = [(k, text(), "en", *[f"{c}{k}" for c in names]) for k in range(6)]
    rows += [(10, rows[0][1], "en", *["x"] * len(names)), (11, " ".join([*rows[1][1].split()[:-1], "end"]), "en", *["y"] * len(names))]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in names)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, text(12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", *names]
    assert sorted(map(tuple, docs.collect())) == sorted([*rows[1:6], rows[6]])


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    """Stages go by rows: an id that comes with several texts, or none, neither saves nor loses a row."""
    rnd = random.Random(3)
    text = lambda n=50: " ".join(rnd.choice(WORDS["en"].split()) + str(rnd.randrange(500)) for _ in range(n))
    a, b, c, item = text(), text(), text(), text(15)
    near = " ".join([*b.split()[:-1], "changed"])
    leaked = " ".join([text(20), item, text(20)])
    long = text(40_000)
    rows = [(1, a), (5, a), (1, c), (None, a), (1, c), (2, b), (None, near), (7, near), (None, leaked), (2, leaked), (None, long), (None, long), (3, text()), (3, text())]
    spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr))
    want = [(5, a), (1, c), (2, b), (7, near), (2, leaked), (None, long), *rows[-2:]]
    assert kept[0] == sorted(rows, key=repr)
    assert kept[1] == sorted(want, key=repr)
    want.remove((7, near))
    assert kept[2] == sorted(want, key=repr)
    want.remove((2, leaked))
    assert kept[3] == sorted(want, key=repr)
