import hashlib
import random

from pyspark.sql import functions as F

from gleanset.llm.fill_middle import fill_middle, restored


def brute(i, t, unit=list):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = unit(t)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, len(u), "plain", None, None, None, t)
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    spm = h4 % 100 < 20
    return (i, len(u), "spm" if spm else "psm", p, m, s, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_against_brute_force(spark, docs_of):
    rnd = random.Random(13)
    chars = ["a", "b", "\u0001", "\u0002", "1", "2", "\n", "\r", " ", "é", "😀", "é", "<", "P", "S", ">", "$", "\\", " ", "\x00"]
    rows = [(k, "".join(rnd.choice(chars) for _ in range(rnd.randrange(0, 40)))) for k in range(400)]
    rows += [(500, None), (501, ""), (None, "no id"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (502, "x<M>y"), (503, "é" * 300_000), (2**60, "large id")]
    rows += [(k, "x" * (k % 3)) for k in range(600, 640)]
    got = fill_middle(docs_of(rows))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(brute(*r)) for r in rows)
    back = got.select("doc_id", restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((i, t or "")) for i, t in rows)
    assert fill_middle(docs_of([])).count() == 0
    assert {r[2] for r in map(tuple, got.collect())} == {"plain", "psm", "spm"}


def test_lines_words_and_other_markers(spark, docs_of):
    rnd = random.Random(14)
    rows = [(k, "".join(rnd.choice(["ab", "\u0001", "\u0002", "\n", " ", "c"]) for _ in range(rnd.randrange(1, 30)))) for k in range(150)]
    lines = lambda t: [x + "\n" for x in t.split("\n")[:-1]] + [x for x in t.split("\n")[-1:] if x]
    got = {tuple(r) for r in fill_middle(docs_of(rows), "line").collect()}
    assert got == {brute(*r, lines) for r in rows}
    for unit, marks in (("word", ("<P>", "<S>", "<M>")), ("char", ("[[prefix]]", "[[end]]", "[[mid]]"))):
        out = fill_middle(docs_of(rows), unit, fim_percent=100, spm_percent=50, markers=marks)
        back = out.select("doc_id", F.concat("prefix", "middle", "suffix").alias("parts"), restored(F.col("output"), F.col("form"), marks).alias("t"))
        assert {tuple(r) for r in back.collect()} == {(i, t, t) for i, t in rows}
