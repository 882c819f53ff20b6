"""Pieces of the oracle SQL."""

from __future__ import annotations

from ravine.sources.tables import TOPICS

_names = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"
#: The chunk table as a common table expression.
CHUNKS = f"""chunks AS (SELECT d.doc_id AS id, d.source AS doc_id, d.text AS content, CAST(floor(d.doc_id / 20) AS INT) AS page_number,
 concat_ws('_', d.source, d.lang) AS section_id, ({_names})[e.label + 1] AS topic,
 CASE WHEN e.label IS NOT NULL THEN [({_names})[e.label + 1], ({_names})[(e.label + 3) % 10 + 1]] END AS topics,
 CAST(e.embedding AS DOUBLE[]) AS embedding, d.lang FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


def q(vec_id: int) -> str:
    return f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {vec_id})"


def cos(vec_id: int, column: str = "embedding") -> str:
    return f"round(list_cosine_similarity({column}, {q(vec_id)}), 6)"


def tok(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), '[^a-z0-9]+'), lambda t: t <> '')"


def hits(column: str, terms: list[str]) -> str:
    return f"len(list_filter({tok(column)}, lambda t: t IN ({', '.join(repr(t) for t in terms)})))"


def tf(column: str, terms: list[str]) -> str:
    return f"({hits(column, terms)} / ({hits(column, terms)} + 1.0))"


def all_terms(column: str, terms: list[str]) -> str:
    return f"list_has_all({tok(column)}, [{', '.join(repr(t) for t in terms)}])"


def any_of(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def labels(expr: str, rules: dict[str, list[str]], default: str) -> str:
    each = ", ".join(f"CASE WHEN {any_of(expr, w)} THEN '{k}' END" for k, w in rules.items())
    return f"coalesce(nullif(array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ','), ''), '{default}')"
