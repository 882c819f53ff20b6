"""The search grammar: terms, "phrases", OR and -negation, over stemmed words without stop words."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from ravine.functions.text import col

#: Words that a query and the ranks leave out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with"]
#: Endings that the light stemmer takes off, in order: pattern (ended by the next character) and what stays.
ENDINGS = [("([a-z]{2,})sses([^a-z0-9]|$)", "$1ss$2"), ("([a-z]{2,})ies([^a-z0-9]|$)", "$1y$2"), ("([a-z]{2,}[b-hj-np-rtv-z])s([^a-z0-9]|$)", "$1$2"), ("([a-z]{3,})ing([^a-z0-9]|$)", "$1$2"), ("([a-z]{3,})ed([^a-z0-9]|$)", "$1$2")]


def stemmed(text: Column | str) -> Column:
    """The lower-case text with its words' endings taken off: a few passes over the whole text."""
    out = F.lower(col(text))
    for pattern, kept in ENDINGS:
        out = F.regexp_replace(out, pattern, kept)
    return out


def stem(word: str) -> str:
    """``stemmed`` for one word of a query."""
    out = word.lower()
    for pattern, kept in ENDINGS:
        out = re.sub(pattern, kept.replace("$", "\\"), out)
    return out


def words(text: Column | str) -> Column:
    """Stemmed words one blank apart, with a blank at either end."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(stemmed(text), "[^a-z0-9]+", " ")), F.lit(" "))


def parse(query: str, stem: Callable[[str], str] = stem) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives (OR) of conditions: whether a run of words must be absent, and its stems.

    AND binds closer than OR. A single stop word is no condition; a phrase keeps its stop words.
    """
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"|(-?[^\s"]+)', query):
        if word.upper() == "OR" and out[-1]:
            out.append([])
            continue
        absent = bool(minus) or word.startswith("-")
        run = re.findall(r"[a-z0-9]+", (phrase or word).lower())
        if run and not (len(run) == 1 and run[0] in STOP_WORDS):
            out[-1].append((absent, [stem(w) for w in run]))
    return [c for c in out if c]


def has(words: Column, run: list[str]) -> Column:
    return F.contains(words, F.lit(" " + " ".join(run) + " "))


def matches(words: Column, parsed: list[list[tuple[bool, list[str]]]]) -> Column:
    """Whether a text's ``words`` meet a parsed query; an empty query matches nothing."""
    if not parsed:
        return F.lit(False)
    one = lambda absent, run: ~has(words, run) if absent else has(words, run)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [one(*c) for c in every]) for every in parsed])


def wanted(parsed: list[list[tuple[bool, list[str]]]]) -> list[str]:
    """The stems that a parsed query asks for, each once, without stop words."""
    return list(dict.fromkeys(w for every in parsed for absent, run in every if not absent for w in run if w not in STOP_WORDS))


def rank(words: Column, parsed: list[list[tuple[bool, list[str]]]]) -> Column:
    """hits / (hits + 1) of the wanted stems."""
    hits = reduce(lambda a, b: a + b, [F.regexp_count(words, F.lit(f" {w}(?= )")) for w in wanted(parsed)], F.lit(0))
    return hits / (hits + 1.0)
