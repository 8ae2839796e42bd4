import random
import re
from collections import defaultdict

from gleanset.llm import substring_dedup as sd


def split(text):
    """Sentences as (words, from, to) with what follows them, by hand."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    out = []
    for k, (a, z) in enumerate(words):
        if not k or text[words[k - 1][1] - 1] in ".!?" or "\n" in text[words[k - 1][1] : a]:
            out.append([])
        out[-1].append((a, z))
    return out


def brute(rows, least_sentences, least_words):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    seen, cut = defaultdict(set), defaultdict(set)
    docs = {(i, t): split(t) for i, t in rows if i is not None and t}
    runs = []
    for (i, t), s in docs.items():
        for a in range(len(s)):
            z, n = a, 0
            while z < len(s) and (z - a < least_sentences or n < least_words):
                n += len(s[z])
                z += 1
            if z - a >= least_sentences and n >= least_words:
                key = tuple(fold(t[x:y]) for k in s[a:z] for x, y in k)
                runs.append((key, i, t, a, z))
                seen[key].add((i, a, t))
    for key, i, t, a, z in runs:
        if (i, a, t) != min(seen[key]):
            cut[i, t] |= set(range(a, z))
    out = []
    for i, t in rows:
        s, gone = split(t), cut.get((i, t), set())
        if not gone:
            out.append((i, len(s) if t else 0, 0, t))
            continue
        edge = [k[0][0] for k in s] + [len(t)]
        out.append((i, len(s), len(gone), t[: edge[0]] + "".join(t[edge[k] : edge[k + 1]] for k in range(len(s)) if k not in gone)))
    return out


def test_against_brute_force(spark, docs_of):
    rnd = random.Random(9)
    pool = [" ".join(rnd.choice("ab cd ef gh ij é kl mn".split()) for _ in range(rnd.randrange(1, 7))) + rnd.choice([".", "!", "?", "", "\n"]) for _ in range(40)]
    rows = [(i, rnd.choice([" ", "  ", "\n"]).join(rnd.choice(pool) for _ in range(rnd.randrange(0, 14)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, rows[0][1]), (3, rows[3][1]), (202, "One more. " * 1500), (203, rows[5][1] + " " + rows[5][1])]
    got = sorted(((r.doc_id, r.n_sentences, r.n_removed, r.text) for r in sd.substring_dedup(docs_of(rows), 2, 6).collect()), key=repr)
    assert got == sorted(brute(rows, 2, 6), key=repr)
    assert sd.substring_dedup(docs_of([])).count() == 0


def test_shared_passage_stays_once(spark, docs_of):
    passage = "The quick fox jumps over that lazy dog today. It then runs far away into the hills. Nobody saw it again until spring came around."
    rows = [(i, f"Opening {i} number {i}. {passage} Closing words {i}.") for i in range(50)]
    got = {r.doc_id: r for r in sd.substring_dedup(docs_of(rows)).collect()}
    assert got[0].text == rows[0][1] and all(got[i].text == f"Opening {i} number {i}. Closing words {i}." for i in range(1, 50))


def every_run(rows, least_sentences, least_words):
    """doc_id -> what is left, by all runs of any length."""
    docs, seen, cut = {i: split(t) for i, t in rows}, defaultdict(list), defaultdict(set)
    for i, t in rows:
        for a in range(len(docs[i])):
            for z in range(a + least_sentences, len(docs[i]) + 1):
                words = tuple(t[x:y].lower() for s in docs[i][a:z] for x, y in s)
                if len(words) >= least_words:
                    seen[words].append((i, a, z))
    for places in seen.values():
        for i, a, z in sorted(places)[1:]:
            cut[i] |= set(range(a, z))
    edges = {i: [s[0][0] for s in docs[i]] + [len(t)] for i, t in rows}
    return {i: t[: edges[i][0]] + "".join(t[edges[i][k] : edges[i][k + 1]] for k in range(len(docs[i])) if k not in cut[i]) for i, t in rows}


def test_short_sentences_at_the_end_of_a_passage(spark, docs_of):
    words = lambda n, k: " ".join(f"w{k}x{j}" for j in range(n)) + "."
    passage = " ".join([words(20, 1), words(3, 2), words(3, 3)])
    rows = [(i, f"{words(5, 100 + i)} {passage} {words(9, 200 + i)}") for i in range(3)] + [(i, passage) for i in (3, 4)]
    got = {r.doc_id: r.text for r in sd.substring_dedup(docs_of(rows), both_ends=True).collect()}
    assert got == every_run(rows, sd.SENTENCES, sd.LEAST_WORDS)
    assert got[1] == f"{words(5, 101)} {words(9, 201)}" and got[3] == got[4] == ""


def test_against_every_run(spark, docs_of):
    rnd = random.Random(10)
    pool = [" ".join(f"{rnd.choice('abcdef')}{rnd.randrange(9)}" for _ in range(rnd.choice([1, 2, 3, 9]))) + "." for _ in range(30)]
    passages = [[rnd.choice(pool) for _ in range(rnd.randrange(2, 9))] for _ in range(12)]
    rows = [(i, " ".join(s for _ in range(rnd.randrange(1, 4)) for s in [*rnd.choice(passages), rnd.choice(pool)])) for i in range(120)]
    for least in ((2, 6), (2, 15), (3, 1)):
        got = {r.doc_id: r.text for r in sd.substring_dedup(docs_of(rows), *least, both_ends=True).collect()}
        assert got == every_run(rows, *least)


def test_query_takes_both_ends(spark, docs_of, tmp_path):
    words = lambda n, k: " ".join(f"w{k}x{j}" for j in range(n)) + "."
    text = " ".join([words(20, 1), words(3, 2), words(3, 3)])
    docs_of([(0, text), (1, text)]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in sd.query(spark, str(tmp_path)).collect()} == {0: text, 1: ""}
