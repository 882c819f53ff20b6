"""Texts made to collide modulo powers of two: Thue-Morse strings and their complements."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from ravine.llm import fmindex, spans, suffixes, tokens


def pair(n, a="a", b="b"):
    t = "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    return t, t.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_pieces_are_compared_by_their_bytes(n):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    texts = ["x" * 8 + t for letters in (("a", "b"), ("9", "h")) for t in pair(n, *letters)]
    encode = tokens.Encoder(tokens.tokenizer_path(), True)
    for together in (texts, texts[::-1]):
        got = encode([np.frombuffer(t.encode(), np.uint8) for t in together])
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in together]


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_hashes_of_equality_differ(n):
    for letters in (("a", "b"), ("9", "h")):
        texts = [np.frombuffer(t.encode(), np.uint8) for t in pair(n, *letters)]
        assert len({int(spans.word_codes(t)[0]) for t in texts}) == 2
        codes = spans.Sums(spans.BYTE_CODES[np.concatenate(texts)], exact=True)
        one, two = codes(np.array([0, n]), np.array([n, 2 * n]))
        assert one != two
        again = spans.Sums(spans.BYTE_CODES[np.concatenate([texts[1], texts[0], texts[1]])], exact=True)
        assert (again(np.array([n, 2 * n]), np.array([2 * n, 3 * n])) == [one, two]).all()


def test_words_that_collide_stay(spark):
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join([*words, t])) for i, t in enumerate(x for n in (512, 1024, 4096) for x in pair(n))]
    docs += [(100, docs[0][1])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["n_removed"] for r in fmindex.dedup_documents(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 100: 13}


def test_bytes_that_collide_stay(spark):
    docs = [(i, t) for i, t in enumerate(pair(512, "9", "h"))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    starts: dict[str, list] = {}
    for i, t in docs:
        for a in range(len(t) - suffixes.LENGTH + 1):
            starts.setdefault(t[a : a + suffixes.LENGTH], []).append((i, a))
    for r in suffixes.dedup_documents(df).collect():
        gone = {a + k for s in starts.values() if len(s) > 1 for i, a in s if i == r["doc_id"] for k in range(suffixes.LENGTH)}
        text = docs[r["doc_id"]][1]
        assert r["n_removed"] == len(gone)
        assert r["kept_sha256"] == hashlib.sha256("".join(c for k, c in enumerate(text) if k not in gone).encode()).hexdigest()
