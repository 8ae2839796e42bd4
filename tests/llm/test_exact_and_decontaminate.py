import hashlib
import random
import re

from gleanset.llm._spark import names
from gleanset.llm.decontaminate import contamination
from gleanset.llm.exact_dedup import DigestIndex, exact_dedup


def test_exact_dedup_and_persistent_index(spark, docs_of):
    rows = [(1, "a"), (5, "a"), (3, "A"), (4, None), (9, ""), (None, "a"), (None, "alone"), (5, "a")]
    index = DigestIndex(spark, buckets=4)
    got = sorted((tuple(r)[:5] for r in exact_dedup(docs_of(rows), index).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    keep = {"a": (5, 4), "A": (3, 1), "": (9, 2), "alone": (None, 1)}
    assert got == sorted(((i, *keep[t or ""], i == keep[t or ""][0], sha(t)) for i, t in rows), key=repr)
    again = DigestIndex(spark, index.path, buckets=4)
    more = {r.doc_id: r for r in exact_dedup(docs_of([(20, "a"), (21, "new"), (22, "new")]), again, batch=1).collect()}
    assert (more[20].kept, more[20].keep_id, more[20].seen_before) == (False, 5, True)
    assert (more[21].kept, more[22].kept, more[21].keep_id) == (False, True, 22)
    assert again.rows().count() == 5
    repeated = {r.doc_id: r for r in exact_dedup(docs_of([(20, "a"), (21, "new"), (22, "new")]), DigestIndex(spark, index.path), batch=1).collect()}
    assert repeated == more and again.rows().count() == 5  # a batch that is run again
    again.rebuild(8)
    assert again.rows().count() == 5 and again.buckets == DigestIndex(spark, again.path).buckets == 8
    assert again.path == index.path and index.rows().count() == 5 and index.buckets == 8  # an open index follows
    assert exact_dedup(docs_of([]), again, 2).count() == 0
    plan = again.unseen(docs_of(rows).selectExpr("text AS digest", "doc_id AS keep_id"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan
    again.drop()


def test_index_after_a_rebuild(spark, docs_of):
    """Another session finds the index by its path, and batches keep their numbers."""
    index = DigestIndex(spark, buckets=4)
    exact_dedup(docs_of([(1, "a"), (2, "b")]), index, 0)
    first = sorted(exact_dedup(docs_of([(3, "b"), (4, "c"), (5, "d")]), index, 1).collect())
    index.rebuild(2)
    by_path = DigestIndex(spark, index.path)
    assert by_path.buckets == 2 and {(r.keep_id, r.batch) for r in by_path.rows().collect()} == {(1, 0), (2, 0), (4, 1), (5, 1)}
    assert sorted(exact_dedup(docs_of([(3, "b"), (4, "c"), (5, "d")]), by_path, 1).collect()) == first
    # A rebuild that was lost before it published its files, and one that was lost before it removed the old ones.
    broken = DigestIndex(spark, index.path)
    spark.range(1).selectExpr("'x' AS digest").write.parquet(broken._place(broken.generation + 1) + "/batch=7")
    assert DigestIndex(spark, index.path).rows().count() == 4
    index.rebuild()
    spark.range(1).selectExpr("'x' AS digest").write.parquet(index._place(1) + "/batch=7")
    assert DigestIndex(spark, index.path).rows().count() == 4
    index.rebuild()
    assert names(spark, index.path) == [f"generation-{index.generation:06d}", f"ready-{index.generation:06d}-2"]
    index.drop()
    assert names(spark, index.path) == []


def brute(rows, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[a : a + window]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if (x := wins.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    found |= {str(i) for i in x if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_against_brute_force(spark, docs_of):
    rnd = random.Random(8)
    vocabulary = ["a", "b", "c", "D", "é", "f1", "GG"]
    say = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", "  ", ", ", "\n"]) for _ in range(n))
    items = [(k, say(rnd.randrange(0, 12))) for k in range(25)] + [(None, "x1 x2 x3 x4 x5"), (3, "a b c d"), (77, None), (78, "?")]
    rows = [(i, say(rnd.randrange(0, 60))) for i in range(200)] + [(500, None), (501, ""), (None, items[4][1]), (7, "q"), (7, "q"), (502, "a " * 40_000), (503, "x1 x2 x3 x4 x5")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for window in (4, 7):
        got = sorted((tuple(r)[:6] for r in contamination(docs_of(rows), benchmark, window=window).collect()), key=repr)
        assert got == brute(rows, items, window)
    r = {x.doc_id: x for x in contamination(docs_of([(1, "zz a b c d e f zz")]), spark.createDataFrame([(9, "b c d e f")], "item_id long, text string"), window=3).collect()}[1]
    assert (r.longest_words, r.longest_item, r.longest_at) == (5, "9", 2)
