import random

from gleanset.llm import licenses
from gleanset.llm.licenses import TEMPLATES, align, increasing


def longest(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        best[i] += max((best[j] for j in range(i) if pairs[j][1] < pairs[i][1]), default=0)
    return max(best, default=0)


def test_increasing_is_longest():
    rnd = random.Random(2)
    for _ in range(300):
        pairs = list(enumerate(rnd.sample(range(30), rnd.randrange(0, 12))))
        got = increasing(pairs)
        assert len(got) == longest(pairs) and all(a[1] < b[1] for a, b in zip(got, got[1:], strict=False))


def test_alignment_rises_and_matches():
    rnd = random.Random(3)
    for _ in range(300):
        t = [rnd.randrange(12) for _ in range(rnd.randrange(1, 15))]
        x = [v for v in t if rnd.random() < 0.8] + [rnd.randrange(12) for _ in range(rnd.randrange(3))]
        got = align(x, t)
        assert all(x[i] == t[j] for i, j in got)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))
    assert align([1, 2, 3, 4, 5], [1, 2, 9, 4, 5]) == [(0, 0), (1, 1), (3, 3), (4, 4)]


def test_scan(spark, docs_of):
    filler = "some plain words that go on and on, for a while " * 3
    rows = [(i, filler + text + "\n" + filler) for i, text in enumerate(TEMPLATES.values())]
    mit = TEMPLATES["MIT"].replace("without restriction", "with no restriction").replace("ANY KIND,", "KINDS")
    rows += [(100, None), (101, ""), (102, "the license of the work"), (103, filler * 4000 + TEMPLATES["ISC"]), (104, mit), (None, "MIT"), (105, "Released under the MIT License. " + filler + "Released under the MIT License."), (100, None)]
    got = {}
    for r in licenses.license_scan(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, name in enumerate(TEMPLATES):
        assert name in [x.license for x in got[i][0].found], name
    assert [(r.n_found, r.best_license, r.best_coverage) for r in got[100]] == [(0, None, 0.0)] * 2
    assert got[101][0].n_found == got[102][0].n_found == got[None][0].n_found == 0
    assert got[103][0].best_license == "ISC" and got[103][0].best_coverage == 1.0
    assert got[104][0].best_license == "MIT" and got[104][0].best_coverage > 0.95
    assert [x.license for x in got[105][0].found] == ["MIT-notice"] * 2
    assert licenses.license_scan(docs_of([])).count() == 0


def test_insertions_against_whole_alignment():
    """Wherever aligning a template with the whole text covers it, with up to SPREAD foreign words in between, it is found."""
    import numpy as np
    import pyarrow as pa

    from gleanset.llm._text import WORDS, Words, utf8

    rnd = random.Random(6)
    hashed = lambda t: Words(*utf8(pa.array([t])), WORDS).hash
    foreign = lambda k: [f"zz{rnd.randrange(10**6)}" for _ in range(k)]
    for t in licenses.templates_of(TEMPLATES):
        if len(t.words) < licenses.LONG:
            continue
        whole = TEMPLATES[t.name].split()
        for pieces, size in ((1, 60), (1, 120), (1, 200), (3, 40), (5, 60)):
            words = list(whole)
            for _ in range(pieces):
                at = rnd.randrange(1, len(words))
                words[at:at] = foreign(size)
            text = hashed(" ".join([*foreign(300), *words, *foreign(300)]))
            brute = len(align(text.tolist(), t.words.tolist())) / len(t.words)
            got = max((c for c, _, _ in licenses.find(text, t)), default=0)
            assert brute >= licenses.COVERAGE and got >= licenses.COVERAGE, (t.name, pieces, size, brute, got)
        assert licenses.find(hashed(" ".join(foreign(2000))), t) == []
        twice = hashed(" ".join([*whole, *foreign(50), *whole]))
        assert len(licenses.find(np.asarray(twice), t)) == 2


def test_copies_that_foreign_words_part():
    """0 to 3 copies of a template, 0 to 2,000 foreign words put into each: all are found, one by one."""
    import pyarrow as pa

    from gleanset.llm._text import WORDS, Words, utf8

    rnd = random.Random(9)
    hashed = lambda t: Words(*utf8(pa.array([t])), WORDS).hash
    foreign = lambda k: [f"zz{rnd.randrange(10**6)}" for _ in range(k)]
    for t in licenses.templates_of(TEMPLATES):
        long = len(t.words) >= licenses.LONG
        for copies in range(4):
            for pieces, size in ((0, 0), (1, 60), (1, 450), (4, 25), (4, 500)):
                if not long and pieces * size > licenses.SPREAD * len(t.words):
                    continue
                words, ends = foreign(30), []
                for _ in range(copies):
                    mine = TEMPLATES[t.name].split()
                    for _ in range(pieces):
                        at = rnd.randrange(1, len(mine))
                        mine[at:at] = foreign(size)
                    words += [*mine, *foreign(rnd.choice([0, 5, 200]))]
                    ends.append(len(hashed(" ".join(words))))
                got = licenses.find(hashed(" ".join(words)), t)
                # Function words that are parted from the telling ones don't count.
                assert len(got) == copies and all(c >= licenses.COVERAGE for c, _, _ in got), (t.name, copies, pieces, size, got)
                assert pieces or all(c == 1.0 for c, _, _ in got)
                assert all(x[2] <= e for x, e in zip(got, ends, strict=True))
    notice = licenses.templates_of({"n": TEMPLATES["Apache-2.0-notice"]})[0]
    words = TEMPLATES["Apache-2.0-notice"].split()
    assert len(licenses.find(hashed(" ".join([*words[:4], *foreign(60), *words[4:]])), notice)) == 1
