"""Searches through the positional text index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.operators import search, text_index, trigram
from ravine.plans import sql as S
from ravine.plans.registry import query
from ravine.plans.search_queries import INCLUDE, TERMS, _BM, _topics, _trigrams, vector
from ravine.sources import functions
from ravine.sources.shared import scratch
from ravine.sources.tables import chunks, table

#: A phrase, a word, a negation, and an alternative.
WEB = '"ci n" que -orre OR heshea'
#: The same as the SQL reads it: words that begin at a place in turn, wanted and absent.
_WEB = [([["ci", "n"], ["que"]], ["orre"]), ([["heshea"]], [])]
PLAIN = "this tion"
_PLAIN = [([["this"], ["tion"]], [])]


def _covers(source: str, alternatives: list) -> str:
    """Common table expressions ending in ranked (id, rank): cover density over (id, text) of ``source``."""
    out, names = f"src AS ({source}), tk AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM (SELECT id, {S.tok('text')} AS t FROM src))", []
    for a, (items, absent) in enumerate(alternatives):
        n = len(items)
        each = []
        for i, run in enumerate(items):
            joins = " ".join(f"JOIN tk t{j} ON t{j}.id = t0.id AND t{j}.pos = t0.pos + {j} AND t{j}.w = '{w}'" for j, w in enumerate(run) if j)
            each.append(f"SELECT t0.id, t0.pos, {i} AS item FROM tk t0 {joins} WHERE t0.w = '{run[0]}'")
        last = ", ".join(f"max(CASE WHEN item = {i} THEN pos * 1000000000 + rn END) OVER w AS l{i}" for i in range(n))
        some = " AND ".join(f"l{i} IS NOT NULL" for i in range(n))
        least = f"least({', '.join(f'l{i}' for i in range(n))})"
        out += f""", e{a} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, item) AS rn FROM ({' UNION ALL '.join(each)})),
 l{a} AS (SELECT id, pos, item, rn, {last} FROM e{a} WINDOW w AS (PARTITION BY id ORDER BY rn ROWS UNBOUNDED PRECEDING)),
 f{a} AS (SELECT id, pos, rn, {least} // 1000000000 AS first, {least} % 1000000000 AS k FROM l{a} WHERE {some}),
 m{a} AS (SELECT *, coalesce(max(first) OVER (PARTITION BY id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM f{a}),
 r{a} AS (SELECT id, sum(0.1::DOUBLE / (1 + greatest(0, (pos - first) - (rn - k)))) AS rank FROM m{a} WHERE first > before AND id NOT IN (SELECT id FROM tk WHERE w IN ('', {', '.join(repr(w) for w in absent) or "''"})) GROUP BY id)"""
        names.append(f"SELECT * FROM r{a}")
    return f"{out}, ranked AS (SELECT id, sum(rank) AS rank FROM ({' UNION ALL '.join(names)}) GROUP BY id)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def _index(spark: SparkSession, sf_dir: str, english: bool = False) -> text_index.TextIndex:
    return text_index.build(_docs(spark, sf_dir), scratch(spark, "text-index"), english=english)


_DOCS = "SELECT doc_id AS id, text FROM documents"


@query(f"WITH {_covers(_DOCS, _WEB)} SELECT id, round(rank / (rank + 1), 6) AS score FROM ranked ORDER BY score DESC, id LIMIT 20")
def fts_cover_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search grammar over the index, by normalised cover density."""
    return _index(spark, sf_dir).search(WEB, 20)


@query(f"WITH {_covers('SELECT doc_id AS id, source || chr(32) || lang || chr(32) || text AS text FROM documents', [([['en'], ['que']], ['src1'])])} SELECT id, round(rank, 6) AS score FROM ranked ORDER BY score DESC, id LIMIT 20")
def fts_section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section path and content are searched together; ranks aren't normalised."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang", "text").alias("text"))
    return text_index.build(docs, scratch(spark, "text-index"), english=False).search("en que -src1", 20, normalised=False)


@query()
def fts_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words stemmed by Porter2; SQL has no stemmer, so tests hold this against a loop."""
    return _index(spark, sf_dir, english=True).search("thereing OR ands -orres", 20)


@query(f"WITH {S.CHUNKS}, {_covers(_DOCS, _WEB)}, s AS (SELECT c.id, {S.cos(0)} AS semantic_score, coalesce(round(rank / (rank + 1), 6), 0.0) AS keyword_score FROM chunks c LEFT JOIN ranked r ON c.id = r.id WHERE embedding IS NOT NULL AND doc_id = 'src1'), t AS (SELECT *, round(0.7 * semantic_score + 0.3 * keyword_score, 6) AS combined_score FROM s) SELECT * FROM t WHERE combined_score > 0 ORDER BY combined_score DESC, id LIMIT 10")
def hybrid_websearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted search of one document, with the grammar."""
    return search.hybrid_index(chunks(spark, sf_dir), _index(spark, sf_dir), vector(spark, sf_dir), WEB, doc_id="src1")


_STATE = "SELECT source AS doc_id, CASE WHEN count(*) % 3 <> 0 THEN 'completed' ELSE 'processing' END AS status, CASE WHEN min(doc_id) % 2 = 0 THEN 'pdf' ELSE 'youtube' END AS source_type FROM documents GROUP BY source"


@query(f"WITH {S.CHUNKS}, {_covers(_DOCS, _PLAIN)}, d AS ({_STATE}) SELECT c.id, source_type, round(0.5 * list_cosine_similarity(embedding, {S.q(0)}) + 0.5 * coalesce(rank, 0.0), 6) AS score FROM chunks c JOIN d USING (doc_id) LEFT JOIN ranked r ON c.id = r.id WHERE status = 'completed' AND source_type = 'pdf' AND embedding IS NOT NULL ORDER BY score DESC, c.id LIMIT 15")
def multi_source_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents that are completed, of the kinds asked for."""
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    d = d.select("doc_id", F.when(F.col("n") % 3 != 0, "completed").otherwise("processing").alias("status"), F.when(F.col("first") % 2 == 0, "pdf").otherwise("youtube").alias("source_type"))
    return search.multi_source_index(chunks(spark, sf_dir), d, _index(spark, sf_dir), vector(spark, sf_dir), PLAIN, ["pdf"])


@query(f"""WITH {S.CHUNKS}, {_covers(_DOCS, _WEB)}, f AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS fts_rank FROM (SELECT r.id, round(rank / (rank + 1), 6) AS s FROM ranked r JOIN chunks c ON c.id = r.id WHERE doc_id IN ('src1', 'src2')) ORDER BY s DESC, id LIMIT 20),
 v AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS vector_rank FROM (SELECT id, {S.cos(0)} AS s FROM chunks WHERE embedding IS NOT NULL AND doc_id IN ('src1', 'src2')) WHERE s > 0.1 ORDER BY s DESC, id LIMIT 20)
 SELECT coalesce(f.id, v.id) AS id, fts_rank, vector_rank, round(coalesce(0.4::DOUBLE / (60 + fts_rank), 0.0) + coalesce(0.6::DOUBLE / (60 + vector_rank), 0.0), 6) AS score,
 CASE WHEN f.id IS NULL THEN 'vector' WHEN v.id IS NULL THEN 'fts' ELSE 'both' END AS match_type FROM f FULL JOIN v ON f.id = v.id ORDER BY score DESC, 1 LIMIT 10""")
def rrf_websearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks over some documents, with the grammar."""
    return search.rrf_index(chunks(spark, sf_dir), _index(spark, sf_dir), vector(spark, sf_dir), WEB, doc_id=["src1", "src2"])


@query(f"""WITH d AS (SELECT doc_id AS id, {S.tok('text')} AS tok FROM documents), c AS (SELECT count(*) AS n, sum(len(tok)) / count(*) AS a, {', '.join(f"count(*) FILTER (list_contains(tok, '{t}')) AS df{i}" for i, t in enumerate(TERMS))} FROM d),
 s AS (SELECT id, round({' + '.join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * ({b} * 2.2::DOUBLE) / ({b} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tok) / a))" for i, b in enumerate(_BM))}, 6) AS score FROM d, c) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10""")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from the postings alone."""
    return _index(spark, sf_dir).bm25(TERMS)


_TITLES = "t AS (SELECT p_partkey AS id, p_name AS title, p_brand AS tag, CASE WHEN p_size % 7 <> 0 THEN 'completed' ELSE 'processing' END AS status FROM part), q AS (SELECT p_partkey AS query_id, CASE p_partkey // 100 % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE upper(substr(p_name, 2, 5)) END AS query FROM part WHERE p_partkey % 100 = 0)"


@query(f"""WITH {_TITLES}, g AS (SELECT id, title, tag, {_trigrams('title')} AS a FROM t WHERE status = 'completed'), h AS (SELECT query_id, query, {_trigrams('query')} AS b FROM q),
 s AS (SELECT query_id, id, title, tag, query, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS similarity FROM g, h),
 m AS (SELECT query_id, id, title, similarity FROM s WHERE similarity > 0.3 OR contains(lower(title), lower(query)) OR tag = query)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM m QUALIFY rank <= 20""")
def doc_search_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 as a query (a title, a tag, or part of a title) against all
    completed documents."""
    p, id_ = table(spark, sf_dir, "part"), F.col("p_partkey")
    docs = p.select(id_.alias("id"), F.col("p_name").alias("title"), F.to_json(F.array("p_brand")).alias("tags"), F.when(F.col("p_size") % 7 != 0, "completed").otherwise("processing").alias("status"))
    kind = F.floor(id_ / 100) % 3
    asked = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.col("p_brand")).otherwise(F.upper(F.substring("p_name", 2, 5)))
    return trigram.search_documents(docs, p.filter(id_ % 100 == 0).select(id_.alias("query_id"), asked.alias("query")))


def _array(values) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


@query(f"WITH {S.CHUNKS} SELECT id, {S.cos(0)} AS similarity FROM chunks WHERE embedding IS NOT NULL AND doc_id = 'src1' AND {S.cos(0)} > 0.01 ORDER BY similarity DESC, id LIMIT 7")
def sql_search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search called in SQL by named arguments."""
    functions.register(chunks(spark, sf_dir))
    return spark.sql(f"SELECT * FROM search_chunks(k => 7, threshold => 0.01, doc => 'src1', query_embedding => {_array(vector(spark, sf_dir))})")


@query(_topics(INCLUDE, []))
def sql_hybrid_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions.register(chunks(spark, sf_dir))
    terms, include = (f"array({', '.join(repr(t) for t in words)})" for words in (TERMS, INCLUDE))
    return spark.sql(f"SELECT * FROM search_chunks_hybrid_with_topics(query_embedding => {_array(vector(spark, sf_dir))}, terms => {terms}, include_topics => {include})")


@query(f"WITH {S.CHUNKS} SELECT id, doc_id, page_number, section_id FROM chunks WHERE id IN (3, 7, 11)")
def sql_chunks_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions.register(chunks(spark, sf_dir))
    return spark.sql("SELECT * FROM get_chunks_by_ids(ids => array(3L, 7L, 11L))")
