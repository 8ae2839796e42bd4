import hashlib
import random
import re
import time

import pyarrow as pa

from gleanset.llm import pii

CONTRACT = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and pii.luhn(d)
    return kind != "phone" or 10 <= len(d) <= 15


def brute(text):
    out = []
    for k, (kind, p) in enumerate(CONTRACT):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if good(kind, m[0])]
    return sorted(out)


def test_base_spans_against_the_patterns():
    rnd = random.Random(3)
    parts = ["a", "b.c", "@", ".", "com", "x_y", "-", "+", "1", "12", "255", "256", "4111111111111111", " ", "(", ")", "é", "4111-1111 1111 1111", "+1 (555) 123-4567", "\n", "%", "00", "😀"]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 14)))
        assert pii.base_spans(t) == brute(t), repr(t)
    assert pii.base_spans("1" * 300_000 + "@") == []
    for place in range(4):  # more digits than a string of an int may have
        for fill, valid in (("0", True), ("1", False)):
            p = ["1"] * 4
            p[place] = fill * 5000 + "1"
            assert pii.base_spans(".".join(p)) == ([(0, 1, 5007)] if valid else [])
    assert pii.base_spans("0" * 5000 + ".0.00.000") == [(0, 1, 5009)]


def test_terms_that_reveal_are_marked_and_removed(spark, docs_of):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3))
    rows = [(i, " ".join(word() for _ in range(20))) for i in range(200)]
    rows += [(1000 + i, f"{word()} {word()} kingfisher écrit to ann@example.com on {word()} {word()}") for i in range(8)]
    rows += [(2000, "the kingfisher é kingfisher"), (None, None), (2001, ""), (2002, "mail bob@example.org " + "word " * 30_000), (3, "copy"), (3, "copy")]
    got = {}
    for r in pii.personal_spans(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append([tuple(s) for s in r.spans])
    assert got[2000] == [[(4, 4, 14), (17, 4, 27)]]
    for i, t in rows:
        assert sorted([s for s in x if s[1] < 4] for x in got[i]) == sorted(brute(u) for j, u in rows if j == i)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs_of(rows)).collect()}
    assert clean[2000] == "the  é " and "<EMAIL>" in clean[1000] and "kingfisher" not in clean[1000]
    assert not any(s[1] == 4 for i in range(200) for x in got[i] for s in x)
    assert pii.personal_spans(docs_of([])).count() == 0


def test_query_digest(spark, tmp_path, docs_of):
    rows = [(1, "ann@example.com and 10.0.0.1"), (2, None)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:0:15,ip:20:28" and (got[1].n_email, got[1].n_ip, got[1].n_card) == (1, 1, 0)
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_documents_are_counted_once_for_each_entity_and_term():
    near = " ".join(["alpha ann@example.com beta " + "filler " * 20, "gamma ann@example.com alpha " + "filler " * 20, "alpha bob@example.com"])
    rows = [r for b in pii._contexts(iter([pa.RecordBatch.from_pydict({"text": [near, near, None, "no entity"]})])) for r in b.to_pylist()]
    pairs = {}
    for r in rows:
        n, contexts = pairs.setdefault((r["entity"], r["term"]), [0, set()])
        pairs[r["entity"], r["term"]] = [n + r["documents"], contexts | {r["context"]}]
    assert len(pairs) > 6 and all(n == 2 for n, _ in pairs.values())
    assert max(len(c) for _, c in pairs.values()) == 2


def test_terms_are_marked_where_no_base_span_is():
    rnd = random.Random(9)
    parts = ["alpha", "beta", "é", "ann@example.com", "x@alpha.com", "10.0.0.1", "+1 555 123 4567", "word", "😀"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(300)] + ["", None]
    data, offsets = pii.utf8(pa.array(["alpha beta"], pa.large_string()))
    import numpy as np

    terms = np.sort(pii.Words(data, offsets, pii.WORDS).hash)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": [t or "" for t in texts]})
    for b in pii._mark(terms, True)(iter([batch])):
        for i, spans in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist(), strict=True):
            base = brute(texts[i])
            words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", texts[i] or "") if m[0] in ("alpha", "beta")]
            want = sorted(base + [(a, 4, z) for a, z in words if not any(x < z and a < y for x, _, y in base)])
            assert [tuple(s.values()) for s in spans] == want, texts[i]


def test_a_long_text_of_addresses_takes_little_time():
    text = " ".join(f"user{i}é some words of alpha near to u{i}@ex.org" for i in range(60_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    began = time.monotonic()
    assert sum(b.num_rows for b in pii._contexts(iter([batch.select(["text"])]))) > 60_000
    terms = pii.Words(*pii.utf8(pa.array(["alpha"], pa.large_string())), pii.WORDS).hash
    (b,) = pii._mark(terms, True)(iter([batch]))
    assert len(b.column("spans")[0]) == 120_000 and time.monotonic() - began < 30
