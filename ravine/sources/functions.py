"""Searches as SQL table functions with named arguments, over a view of the chunks.

``SELECT * FROM search_chunks(query_embedding => array(...), k => 5)``. A limit can't be a parameter,
so the functions filter by rank, which Spark plans as a top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_COSINE = """round(CASE WHEN size(embedding) <> size(query_embedding) THEN 0D ELSE try_divide(
  aggregate(zip_with(embedding, query_embedding, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x),
  sqrt(aggregate(embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * sqrt(aggregate(query_embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) END, 6)"""
_HITS = "aggregate(array_distinct(terms), 0, (s, t) -> s + CAST((length(w) - length(replace(w, concat(' ', t, ' '), ''))) / (length(t) + 2) AS INT))"
_BOOST = """CASE WHEN include_topics IS NULL OR size(include_topics) = 0 THEN 1D WHEN size(array_intersect(coalesce(topics, array()), include_topics)) >= 2 THEN 1.5D
  WHEN size(array_intersect(coalesce(topics, array()), include_topics)) >= 1 OR coalesce(array_contains(include_topics, topic), false) THEN 1.3D ELSE 1D END"""
_KEPT = "exclude_topics IS NULL OR size(exclude_topics) = 0 OR (NOT arrays_overlap(topics, exclude_topics) AND (topic IS NULL OR NOT array_contains(exclude_topics, topic)))"
_SCORED = f"""SELECT id, boost, v, CASE WHEN forall(terms, t -> contains(w, concat(' ', t, ' '))) THEN round({_HITS} / ({_HITS} + 1D), 6) END AS kw FROM (
  SELECT id, {_BOOST} AS boost, {_COSINE} AS v, concat(' ', btrim(regexp_replace(lower(content), '[^a-z0-9]+', '  ')), ' ') AS w FROM chunks_view WHERE {_KEPT})"""

#: Name, parameters, columns and body of each function; ``chunks_view`` stands for the view.
FUNCTIONS = {
    "search_chunks": (
        "query_embedding ARRAY<DOUBLE>, doc STRING DEFAULT NULL, threshold DOUBLE DEFAULT 0.3, k INT DEFAULT 10",
        "id BIGINT, similarity DOUBLE",
        f"""SELECT id, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS place FROM (
              SELECT id, {_COSINE} AS similarity FROM chunks_view WHERE embedding IS NOT NULL AND (doc IS NULL OR doc_id = doc)) WHERE similarity > threshold) WHERE place <= k""",
    ),
    "search_chunks_hybrid_with_topics": (
        "query_embedding ARRAY<DOUBLE>, terms ARRAY<STRING>, include_topics ARRAY<STRING> DEFAULT NULL, exclude_topics ARRAY<STRING> DEFAULT NULL, semantic_weight DOUBLE DEFAULT 0.5, keyword_weight DOUBLE DEFAULT 0.5, k INT DEFAULT 10",
        "id BIGINT, semantic_score DOUBLE, keyword_score DOUBLE, topic_boost DOUBLE, final_score DOUBLE",
        f"""SELECT id, semantic_score, keyword_score, topic_boost, final_score FROM (
              SELECT *, row_number() OVER (ORDER BY final_score DESC, id) AS place FROM (
                SELECT id, max(sem) AS semantic_score, max(kw) AS keyword_score, max(boost) AS topic_boost, round((semantic_weight * max(sem) + keyword_weight * max(kw)) * max(boost), 6) AS final_score FROM (
                  SELECT id, boost, coalesce(v, 0D) AS sem, 0D AS kw FROM (SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, id) AS place FROM ({_SCORED})) WHERE place <= 2 * k
                  UNION ALL
                  SELECT id, boost, 0D, kw FROM (SELECT *, row_number() OVER (ORDER BY kw DESC, id) AS place FROM ({_SCORED}) WHERE kw IS NOT NULL) WHERE place <= 2 * k)
                GROUP BY id)) WHERE place <= k""",
    ),
    "get_chunks_by_ids": (
        "ids ARRAY<BIGINT>",
        "id BIGINT, doc_id STRING, page_number INT, section_id STRING",
        "SELECT id, doc_id, page_number, section_id FROM chunks_view WHERE array_contains(ids, id)",
    ),
}


def register(chunks: DataFrame, view: str = "chunks") -> None:
    """Make the functions for this session, over ``chunks`` (id, doc_id, content, page_number, section_id,
    topic, topics, embedding)."""
    chunks.createOrReplaceTempView(view)
    for name, (parameters, columns, body) in FUNCTIONS.items():
        chunks.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body.replace('chunks_view', view)}")
