"""Rank expressions: term frequency, BM25, topic boost, reciprocal ranks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

from ravine.functions.text import has_token, token_hits

RRF_K = 60


def hits(spaced: Column, terms: list[str]) -> Column:
    """How many tokens are among the terms (see ``text.spaced``)."""
    return reduce(lambda a, b: a + b, [token_hits(spaced, t) for t in dict.fromkeys(terms)], F.lit(0))


def all_terms(spaced: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [has_token(spaced, t) for t in terms], F.lit(True))


def any_term(spaced: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [has_token(spaced, t) for t in terms], F.lit(False))


def tf_norm(spaced: Column, terms: list[str]) -> Column:
    """hits / (hits + 1): from 0 to below 1."""
    h = hits(spaced, terms)
    return h / (h + 1.0)


def bm25(counts: dict[str, Column], size: Column, n: int, df: dict[str, int], avg: float, k1: float = 1.2, b: float = 0.75) -> Column:
    """Okapi BM25 from a row's counts of the terms and its size, with the corpus' counts as parameters."""
    out = F.lit(0.0)
    for t, tf in counts.items():
        idf = math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))
        out = out + F.lit(idf) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * size / F.lit(avg)))
    return out


def topic_boost(topic: Column, topics: Column, include: list[str] | None) -> Column:
    """1.5 for two wanted topics, 1.3 for one (or the main topic), else 1."""
    if not include:
        return F.lit(1.0)
    wanted = F.array(*map(F.lit, include))
    both = F.size(F.array_intersect(F.coalesce(topics, F.array().cast("array<string>")), wanted))
    return F.when(both >= 2, 1.5).when((both >= 1) | F.coalesce(topic.isin(*include), F.lit(False)), 1.3).otherwise(1.0)


def reciprocal(rank: Column, weight: float = 1.0, k: int = RRF_K) -> Column:
    """weight / (k + rank) for a rank from 1; 0 where the list lacks the row."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))
