"""Many keywords in one pass: an Aho-Corasick automaton over batches of texts."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F


@lru_cache(maxsize=64)
def _automaton(words: tuple[str, ...]):
    """Finds each word as a substring; its value is its place."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, w in enumerate(words):
        a.add_word(w, i)
    a.make_automaton()
    return a


def labels(text: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The labels of which a keyword occurs in a lower-case text, in the rules' order; the default where
    none does, and for null."""
    first: dict[str, list[int]] = {}
    for i, words in enumerate(rules.values()):
        for w in words:
            first.setdefault(w, []).append(i)
    words, owners, names = tuple(first), [frozenset(o) for o in first.values()], list(rules)

    @F.arrow_udf("array<string>")
    def scan(texts: pa.Array) -> pa.Array:
        find, out = _automaton(words).iter, []
        for t in texts.to_pylist():
            of: frozenset[int] = frozenset().union(*(owners[i] for i in {i for _, i in find(t)})) if t else frozenset()
            out.append([names[i] for i in sorted(of)] or [default])
        return pa.array(out, pa.list_(pa.string()))

    return scan(text)


def counts(text: Column, words: list[str]) -> Column:
    """How often each word occurs in a text, as an array beside the words; occurrences of one word that
    overlap count once. Null for null."""
    distinct = tuple(dict.fromkeys(words))
    places = [distinct.index(w) for w in words]

    @F.arrow_udf("array<bigint>")
    def scan(texts: pa.Array) -> pa.Array:
        find, sizes, out = _automaton(distinct).iter, [len(w) for w in distinct], []
        for t in texts.to_pylist():
            n, free = [0] * len(distinct), [0] * len(distinct)
            for end, i in find(t) if t else ():
                if end + 1 - sizes[i] >= free[i]:
                    n[i], free[i] = n[i] + 1, end + 1
            out.append(None if t is None else [n[i] for i in places])
        return pa.array(out, pa.list_(pa.int64()))

    return scan(text)
