import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from gleanset.llm import bpe

PATH, PATTERN = bpe.vocabulary()


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("ref", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_character_as_the_library(reference):
    c = bpe.Codec(PATH, PATTERN)
    for lo in range(0, 0x40000, 0x400):
        cps = [x for x in range(lo, lo + 0x400) if not 0xD800 <= x < 0xE000]
        if not cps:
            continue
        text = "".join(f"a{chr(x)}1 {chr(x)} {chr(x)}{chr(x)}'s" for x in cps)
        if c.encode(text).tolist() != reference.encode_ordinary(text):
            odd = [hex(x) for x in cps if c.encode(f"a{chr(x)}1 {chr(x)} {chr(x)}{chr(x)}'s").tolist() != reference.encode_ordinary(f"a{chr(x)}1 {chr(x)} {chr(x)}{chr(x)}'s")]
            raise AssertionError(odd)


@pytest.mark.parametrize("chunk,overlap", [(8, 4), (16, 3), (64, 8), (50, 40)])
def test_chunks_stitch(reference, chunk, overlap):
    rnd = random.Random(chunk)
    c = bpe.Codec(PATH, PATTERN, chunk, overlap)
    parts = ["the", " ", "  ", "\n\n", "'s", "'re", "'", "x" * 30, " " * 40, "123", "é", "漢字", "!!", ".", "\t", " 'l", "'ll", "😀"]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 60)))
        ids = c.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text), repr(text)
        assert c.decode(ids) == text.encode()


def test_threads_agree(reference):
    text = "Some words, and 12 more's. " * 2000
    assert bpe.Codec(PATH, PATTERN, 1000, 50, threads=4).encode(text).tolist() == reference.encode_ordinary(text)


def test_rows(spark, docs_of, reference):
    rows = [(1, "Hello world's end"), (2, None), (3, ""), (4, "x" * 200_000), (None, "a  b"), (1, "Hello world's end"), (5, "<|endoftext|>")]
    out = sorted(map(tuple, bpe.bpe_digest(docs_of(rows), PATH, PATTERN).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert out == sorted(want, key=repr)
    back = bpe.bpe_decode(bpe.bpe_encode(docs_of(rows), PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.text) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert bpe.bpe_digest(docs_of([]), PATH, PATTERN).count() == 0


def test_merges_against_the_library():
    """The merge loop, short and long pieces, against the library's encoder."""
    import base64
    import random

    import tiktoken

    path, pattern = bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec, rnd = bpe.Codec(path, pattern), random.Random(4)
    for n in [1, 2, 3, 5, 9, 20, 47, 48, 49, 60, 200, 3000] * 12:
        letters = rnd.choice(["ab", "theandingor", "aeioubcdfgß", "日本語の", "0123456789", "§=-"])
        piece = "".join(rnd.choice(letters) for _ in range(n))
        want = library._encode_single_piece(piece) if hasattr(library, "_encode_single_piece") else library._core_bpe.encode_single_piece(piece.encode())
        assert codec.merged(piece.encode()) == want == codec._merged_long(piece.encode()), piece
    assert codec.decode(codec.encode("z" * 200_000)) == b"z" * 200_000
