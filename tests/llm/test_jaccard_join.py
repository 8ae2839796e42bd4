import random
import re

import numpy as np
import pytest

from gleanset.llm import components as components_module
from gleanset.llm import jaccard_join as jj
from gleanset.llm._spark import Scratch
from gleanset.llm.components import components


def shingles(t):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", fold)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    ids = sorted({i for i, _ in rows if i is not None})
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    s = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return sorted(((i, len(shingles(t)), None if i is None else root(i)) for i, t in rows), key=repr)


def near_copies(rnd, n_base, copies, length, edits):
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, i = [], 0
    for _ in range(n_base):
        base = rnd.choices(vocabulary, k=rnd.randrange(*length))
        for _ in range(rnd.randrange(1, copies)):
            t = list(base)
            for _ in range(rnd.randrange(0, edits)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((i, " ".join(t)))
            i += 1
    rnd.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_against_brute_force(spark, docs_of):
    rnd = random.Random(12)
    rows = near_copies(rnd, 40, 16, (5, 160), 7)
    shared = " ".join(f"p{k}" for k in range(40))
    rows += [(5000 + k, shared + " " + " ".join(f"q{k}x{j}" for j in range(30))) for k in range(30)]
    rows += [(6000, None), (6001, ""), (6002, "  \n"), (6003, "one two"), (6004, "ONE two"), (6005, "one two three"), (None, rows[0][1]), rows[1]]
    assert got(jj.jaccard_join(docs_of(rows))) == brute(rows)
    assert jj.jaccard_join(docs_of([])).count() == 0
    assert got(jj.jaccard_join(docs_of([(1, None), (2, "a")]))) == [(1, 0, 1), (2, 1, 2)]


def test_chains_and_windows(spark, docs_of, monkeypatch):
    """A sliding chain of texts: neighbours link, far ones don't, and regions touch only by their members."""
    words = [f"w{k}" for k in range(700)]
    rows = [(1000 - i, " ".join(words[i * 3 : i * 3 + 120])) for i in range(150)]
    rows += [(3000 + i, " ".join(words[200 + i : 320 + i] + [f"z{i}"] * (i % 5))) for i in range(0, 60, 3)]
    want = brute(rows)
    assert got(jj.jaccard_join(docs_of(rows))) == want
    monkeypatch.setattr(jj, "GROUP", 5)
    monkeypatch.setattr(jj, "PIVOTS", 1)
    assert got(jj.jaccard_join(docs_of(rows))) == want


def test_salted_groups_of_near_copies(spark, docs_of, monkeypatch):
    monkeypatch.setattr(jj, "GROUP", 20)
    rnd = random.Random(5)
    rows = near_copies(rnd, 2, 200, (100, 140), 9)
    assert got(jj.jaccard_join(docs_of(rows))) == brute(rows)


@pytest.mark.parametrize("most", [0, 1 << 21])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components_module, "IN_ONE_TASK", most)
    rnd = np.random.Generator(np.random.PCG64(1))
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    top = {}

    def root(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    out = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c").collect()
    assert {r.id: r.component for r in out} == {i: root(i) for i in top} and len(out) == len(top)


def test_recursion_of_regions(spark, docs_of, monkeypatch):
    """Spaces of three points: several levels of pivots and windows, and blocks where regions don't shrink."""
    for name, value in {"LEAF": 6, "COLD": 2, "BLOCK": 3, "PIVOTS": 2, "ROUNDS": 1}.items():
        monkeypatch.setattr(jj, name, value)
    levels = set()
    split, blocks = jj.Join._split, jj.Join._blocks
    monkeypatch.setattr(jj.Join, "_split", lambda self, points, name: (None if points.isEmpty() else levels.add(name), split(self, points, name))[1])
    monkeypatch.setattr(jj.Join, "_blocks", lambda self, points: (None if points.isEmpty() else levels.add("blocks"), blocks(self, points))[1])
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(70):  # a chain of variants beside others that are all about as far from each other
        t = [*base[: 100 - i // 3], *(f"c{k}" for k in range(i // 3))] if i < 30 else [w if rnd.random() < 0.97 else f"{w}x{i}" for w in base]
        rows.append((500 - i, " ".join(t)))
    assert got(jj.jaccard_join(docs_of(rows))) == brute(rows)
    assert {"blocks", "cells-1"} <= levels


def test_levels_of_a_space(spark, docs_of, monkeypatch):
    """Sixteen groups of variants in one space: pivots split it again and again, and no pair within r is lost."""
    for name, value in {"LEAF": 30, "PIVOTS": 4, "SHRINK": 0.95}.items():
        monkeypatch.setattr(jj, name, value)
    levels = set()
    split = jj.Join._split
    monkeypatch.setattr(jj.Join, "_split", lambda self, points, name: (None if points.isEmpty() else levels.add(name), split(self, points, name))[1])
    rnd = random.Random(9)
    rows = [(12 * g + i, " ".join(w if rnd.random() < 0.98 else f"{w}x{i}" for w in (f"g{g // 4}a{k}" if k < 30 else f"g{g}w{k}" for k in range(60)))) for g in range(16) for i in range(12)]
    join = jj.Join(docs_of(rows), 4, 85, "doc_id", "text")
    join.rank = jj.bucket_ranks(join.docs.select("text"), 4)
    profile = join.docs.mapInArrow(jj._profile(join.rank, 4, 85), "doc_id long, row long, n long, f1 long, f2 long, m0 long, m1 long, m2 long, prefix array<long>, sig binary")
    join.active = join.work.keep(profile.selectExpr("doc_id AS node", "row", "n", "sig"), "active")
    pairs = {(r.a, r.b) for r in join._spaces(join.active.selectExpr("7L AS space", "node", "node AS component", "0 AS side", "n", "sig", "0D AS radius"), "test").collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = {(i, j) for i, x in sets.items() for j, y in sets.items() if i < j and 100 * len(x & y) >= 85 * len(x | y)}
    assert links <= pairs and len(pairs) < 3 * len(links) and len(levels) >= 2, (len(links), len(pairs), levels)


def test_one_of_each(spark, docs_of):
    base = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join([*base[:59], f"x{k}"])
    rows = [(7, " ".join(base)), (3, near(1)), (None, near(2)), (3, "another text of some six words"), (9, None), (9, ""), (None, "alone and without any id here")]
    kept = sorted(((r.doc_id, r.text) for r in jj.one_of_each(docs_of(rows)).collect()), key=repr)
    assert kept == sorted([rows[1], *rows[3:]], key=repr)
