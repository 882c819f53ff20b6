"""Large groups of candidates lose no link, whatever the candidates were."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ravine.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def classes(n, links):
    of = list(range(n))
    for a, b in links:
        of = [of[a] if x == of[b] else x for x in of]
    return {frozenset(i for i in range(n) if of[i] == c) for c in set(of)}


@pytest.mark.parametrize("group, block, size", [(3, 2048, 1 << 20), (3, 16, 1 << 20), (3, 2048, 4096), (64, 2048, 1 << 20)])
def test_no_link_is_lost(spark, monkeypatch, group, block, size):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "PART_BLOCK", block)
    monkeypatch.setattr(simhash, "PART_BYTES", size)
    rng = random.Random(7)
    bases = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    texts = []
    for k in range(40):
        words = list(bases[k % 4])
        for _ in range(rng.randrange(4)):  # some copies of a base are alike only by way of others
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += ["", "one two", "one two", "a0 a1 a2"]
    n = len(texts)
    true = [(i, j) for i in range(n) for j in range(i) if len(shingles(texts[i]) & shingles(texts[j])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[j])) and bool(texts[i]) == bool(texts[j])]
    chain = [(i, i + 1) for i in range(n - 1)]  # neighbours are never alike, but for "one two"
    t = spark.createDataFrame([(i + 1000, x) for i, x in enumerate(texts)], "__rk bigint, text string").repartition(3)
    nodes = spark.createDataFrame([(i, i + 1000) for i in range(n)], "node bigint, __rk bigint")
    got = [(r["a"], r["b"]) for r in simhash._verified(t, nodes, spark.createDataFrame(chain, "a bigint, b bigint"), 0.8).collect()]
    assert set(map(frozenset, got)) <= set(map(frozenset, true))
    assert classes(n, got) == classes(n, true)


def test_links_between_parts():
    """Against all pairs: sets of every size around the threshold, in one block and between two."""
    rng = np.random.default_rng(3)
    bases = [rng.permutation(4000)[:k].astype(np.uint32) for k in (1, 4, 5, 15, 40, 41, 300)]
    sets = []
    for _ in range(150):
        base = bases[rng.integers(len(bases))]
        kept = base[rng.random(len(base)) < rng.choice([0.8, 0.9, 0.97])]
        sets.append(np.unique(np.append(kept, rng.integers(4000, size=rng.integers(3)).astype(np.uint32)) if len(kept) else base))
    n = len(sets)
    for side in (np.zeros(n, int), np.arange(n) % 2):
        part = rng.integers(100, size=n)
        same = [(i, j) for i in range(n) for j in range(i) if part[i] == part[j]]
        true = [(i, j) for i in range(n) for j in range(n) if i != j and (side[i] != side[j] if side.any() else True) and simhash.alike(sets[i], sets[j], 0.8)]
        got = simhash.between(side, part, sets, 0.8)
        assert set(got) <= set(true) and len(got) < n
        assert classes(n, got + same) == classes(n, true + same)
