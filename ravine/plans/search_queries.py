"""Retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.operators import analytics, expand, search, vector_index
from ravine.functions import text
from ravine.plans import sql as S
from ravine.plans.lookup_queries import _WORDS
from ravine.plans.registry import query
from ravine.sources.shared import scratch, spread
from ravine.sources.tables import chunks, document_index, table

TERMS = ["that", "with"]
INCLUDE, EXCLUDE = ["graphics", "hardware"], ["graphics"]
SOURCES = ["src0", "src1", "src2"]


def vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The query vector: an embedding of the table (one row)."""
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding)


def _chunk_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"SELECT vec_id AS id, {S.cos(0, 'CAST(embedding AS DOUBLE[])')} AS similarity FROM embeddings WHERE {S.cos(0, 'CAST(embedding AS DOUBLE[])')} > 0.3 ORDER BY similarity DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(_chunk_vectors(spark, sf_dir), vector(spark, sf_dir)).select("id", "similarity")


@query(f"WITH {S.CHUNKS} SELECT id, {S.cos(0)} AS similarity, lang FROM chunks WHERE lang = 'en' AND embedding IS NOT NULL AND {S.cos(0)} > 0.0 ORDER BY similarity DESC, id LIMIT 20")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(chunks(spark, sf_dir), vector(spark, sf_dir), 0.0, 20, lang="en", section_id=None).select("id", "similarity", "lang")


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
 FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""")
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 against all rows."""
    e = _chunk_vectors(spark, sf_dir)
    return search.batch_vector_search(e, e.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"))


_HYBRID = f"""s AS (SELECT id, {S.cos(0)} AS semantic_score, round(CASE WHEN {S.all_terms('content', TERMS)} THEN {S.tf('content', TERMS)} ELSE 0 END, 6) AS keyword_score FROM chunks WHERE embedding IS NOT NULL)"""


@query(f"WITH {S.CHUNKS}, {_HYBRID}, t AS (SELECT *, round(0.7 * semantic_score + 0.3 * keyword_score, 6) AS combined_score FROM s) SELECT id, semantic_score, CAST(keyword_score AS DOUBLE) AS keyword_score, CAST(combined_score AS DOUBLE) AS combined_score FROM t WHERE combined_score > 0 ORDER BY combined_score DESC, id LIMIT 10")
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(chunks(spark, sf_dir, True), vector(spark, sf_dir), TERMS).select("id", "semantic_score", "keyword_score", "combined_score")


def _topics(include: list[str], exclude: list[str], k: int = 10) -> str:
    inc = "[" + ", ".join(f"'{t}'" for t in include) + "]"
    exc = "[" + ", ".join(f"'{t}'" for t in exclude) + "]"
    keep = f"NOT list_has_any(topics, {exc}) AND (topic IS NULL OR NOT list_contains({exc}, topic))" if exclude else "TRUE"
    boost = f"CASE WHEN len(list_intersect(coalesce(topics, []), {inc})) >= 2 THEN 1.5 WHEN len(list_intersect(coalesce(topics, []), {inc})) >= 1 OR coalesce(list_contains({inc}, topic), FALSE) THEN 1.3 ELSE 1.0 END" if include else "1.0"
    return f"""WITH {S.CHUNKS}, s AS (SELECT id, {boost} AS boost, {S.cos(0)} AS v, CASE WHEN {S.all_terms('content', TERMS)} THEN round({S.tf('content', TERMS)}, 6) END AS w FROM chunks WHERE {keep}),
 a AS (SELECT id, boost, coalesce(v, 0.0) AS sem, 0.0 AS kw FROM s ORDER BY v DESC NULLS LAST, id LIMIT {2 * k}), b AS (SELECT id, boost, 0.0 AS sem, w AS kw FROM s WHERE w IS NOT NULL ORDER BY w DESC, id LIMIT {2 * k}),
 m AS (SELECT id, max(sem) AS semantic_score, max(kw) AS keyword_score, max(boost) AS topic_boost FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)
 SELECT id, CAST(semantic_score AS DOUBLE) AS semantic_score, CAST(keyword_score AS DOUBLE) AS keyword_score, CAST(topic_boost AS DOUBLE) AS topic_boost, CAST(round((0.5 * semantic_score + 0.5 * keyword_score) * topic_boost, 6) AS DOUBLE) AS final_score FROM m ORDER BY final_score DESC, id LIMIT {k}"""


@query(_topics(INCLUDE, []))
def hybrid_topic_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_topics(chunks(spark, sf_dir, True), vector(spark, sf_dir), TERMS, INCLUDE)


@query(_topics([], EXCLUDE))
def hybrid_topic_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_topics(chunks(spark, sf_dir, True), vector(spark, sf_dir), TERMS, None, EXCLUDE)


@query(f"""WITH {S.CHUNKS}, s AS (SELECT id, doc_id AS source, CAST(round(0.5 * list_cosine_similarity(embedding, {S.q(0)}) + 0.5 * {S.tf('content', TERMS)}, 6) AS DOUBLE) AS score FROM chunks WHERE doc_id IN ('src0', 'src1', 'src2') AND embedding IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5 ORDER BY score DESC, id LIMIT 15""")
def hybrid_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.multi_source(chunks(spark, sf_dir, True), vector(spark, sf_dir), TERMS, SOURCES)


@query(f"""WITH {S.CHUNKS}, f AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS fts_rank FROM (SELECT id, round({S.tf('content', TERMS)}, 6) AS s FROM chunks) WHERE s > 0 ORDER BY s DESC, id LIMIT 20),
 v AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS vector_rank FROM (SELECT id, {S.cos(0)} AS s FROM chunks WHERE embedding IS NOT NULL) WHERE s > 0.1 ORDER BY s DESC, id LIMIT 20)
 SELECT coalesce(f.id, v.id) AS id, fts_rank, vector_rank, round(coalesce(0.4::DOUBLE / (60 + fts_rank), 0.0) + coalesce(0.6::DOUBLE / (60 + vector_rank), 0.0), 6) AS score,
 CASE WHEN f.id IS NULL THEN 'vector' WHEN v.id IS NULL THEN 'fts' ELSE 'both' END AS match_type FROM f FULL JOIN v ON f.id = v.id ORDER BY score DESC, 1 LIMIT 10""")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rrf(chunks(spark, sf_dir, True), vector(spark, sf_dir), TERMS)


@query("""WITH s AS (SELECT q.vec_id - q.vec_id % 100 AS group_id, CAST(q.vec_id % 100 AS INT) AS variant, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 100 < 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY group_id, variant ORDER BY similarity DESC, id) AS rank FROM s),
 f AS (SELECT group_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(*) AS appearances, round(avg(rank - 1), 6) AS avg_rank, array_to_string(list_sort(list(variant)), ',') AS variants FROM r WHERE rank <= 20 GROUP BY 1, 2)
 SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) AS INT) AS rank, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) <= 10 THEN 'golden' ELSE 'backup' END AS tier FROM f QUALIFY rank <= 15""")
def rrf_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query (id divisible by 100) has five variants: its vector and the next four."""
    e = _chunk_vectors(spark, sf_dir)
    lists = search.batch_vector_search(e, e.filter("id % 100 < 5").select(F.col("id").alias("query_id"), "embedding"), 20)
    lists = lists.select((F.col("query_id") - F.col("query_id") % 100).alias("group_id"), (F.col("query_id") % 100).cast("int").alias("variant"), "id", "rank")
    return search.golden(search.rrf_queries(lists)).withColumn("variants", F.array_join("variants", ","))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.label, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
 r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 12) SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM r QUALIFY rank <= 5""")
def merged_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _chunk_vectors(spark, sf_dir)
    lists = search.batch_vector_search(e, e.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), 12)
    return search.merged_golden(lists.select("query_id", "id", F.col("similarity").alias("score")))


@query(f"WITH {S.CHUNKS} SELECT id, {S.cos(2)} AS similarity FROM chunks WHERE doc_id = 'src1' AND embedding IS NOT NULL AND {S.cos(2)} > 0.05 ORDER BY similarity DESC, id LIMIT 10")
def match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match_documents(chunks(spark, sf_dir), vector(spark, sf_dir, 2), "src1", 0.05).select("id", "similarity")


@query(f"SELECT doc_id AS id, CAST(round({S.tf('text', TERMS)}, 6) AS DOUBLE) AS score FROM documents WHERE {S.all_terms('text', TERMS)} ORDER BY score DESC, id LIMIT 20")
def keyword_search_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_search(spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id"), "text", TERMS).select("id", "score")


_BM = [f"(len(list_filter(tok, lambda x: x = '{t}')))" for t in TERMS]


@query(f"""WITH d AS (SELECT doc_id AS id, {S.tok('text')} AS tok FROM documents), c AS (SELECT count(*) AS n, avg(len(tok)) AS a, {', '.join(f"count(*) FILTER (list_contains(tok, '{t}')) AS df{i}" for i, t in enumerate(TERMS))} FROM d),
 s AS (SELECT id, round({' + '.join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * ({b} * 2.2::DOUBLE) / ({b} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tok) / a))" for i, b in enumerate(_BM))}, 6) AS score FROM d, c) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10""")
def keyword_search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_search(spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id"), "text", TERMS)


@query(f"WITH p AS (SELECT page_id AS id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages) SELECT id, CAST(round({S.tf('t', ['the', 'and'])}, 6) AS DOUBLE) AS score FROM p WHERE list_has_any({S.tok('t')}, ['the', 'and']) ORDER BY score DESC, id LIMIT 10")
def keyword_search_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_replace("html", "<[^>]*>", " ").alias("t"))
    return search.keyword_search(pages, "t", ["the", "and"], 10, any_=True).select("id", "score")


@query(f"WITH {S.CHUNKS} SELECT id, {S.cos(1)} AS similarity FROM chunks WHERE embedding IS NOT NULL ORDER BY similarity DESC, id LIMIT 20 OFFSET 20")
def doc_semantic_list_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(chunks(spark, sf_dir), vector(spark, sf_dir, 1), -2.0, 40).select("id", "similarity").orderBy(F.col("similarity").desc(), "id").offset(20)


def _trigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, len('  ' || lower({x}) || ' ') - 1), lambda i: substring('  ' || lower({x}) || ' ', i, 3)))"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_name AS title, {_trigrams('p_name')} AS a, (SELECT {_trigrams("'small ring'")}) AS b FROM part),
 s AS (SELECT id, title, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS similarity FROM p) SELECT * FROM s WHERE similarity > 0.3 OR title ILIKE '%small ring%' ORDER BY similarity DESC, id LIMIT 20""")
def doc_fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_search(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "small ring")


_INDEX = "idx AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text AS summary FROM documents)"
_PTS = " + ".join(f"(contains(lower(title), '{t}'))::INT * 3 + (contains(lower(summary), '{t}'))::INT" for t in ("heshea", "onthe"))


@query(f"""WITH {_INDEX}, s AS (SELECT id, CASE WHEN list_has_any({S.tok('summary')}, ['heshea', 'onthe']) THEN 1 WHEN {S.any_of('title', ['heshea', 'onthe'])} THEN 2 ELSE 3 END AS stage,
 {_PTS} + (contains(lower(concat_ws(' ', title, summary)), 'heshea onthe'))::INT * 5 AS points FROM idx), m AS (SELECT min(stage) AS least FROM s)
 SELECT id, stage, points FROM s, m WHERE stage = least ORDER BY points DESC, id LIMIT 3""")
def doc_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.route(document_index(spark, sf_dir), "heshea onthe")


def _cache(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cache = c.join(e, c.conv_id == e.vec_id, "left").withColumn("doc", F.lit("all")).withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return cache.withColumn("cache_key", text.cache_key("text", "doc")).withColumn("created_at", F.expr("timestamp'2024-01-30 00:00:00' - make_interval(0,0,0,cast(turn as int))"))


@query(f"""WITH c AS (SELECT conv_id * 100 + turn AS id, sha256(translate(lower(trim(text)), '?.,', '') || ':all') AS cache_key, TIMESTAMP '2024-01-30' - to_days(CAST(turn AS INT)) AS created_at, CAST(embedding AS DOUBLE[]) AS embedding FROM conversations LEFT JOIN embeddings ON conv_id = vec_id WHERE role = 'user'),
 m AS (SELECT id, cache_key, CASE WHEN cache_key = sha256('nothing here:all') THEN 2.0 WHEN {S.cos(3)} >= 0.95 THEN {S.cos(3)} END AS match FROM c WHERE created_at > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) SELECT id, cache_key, CAST(match AS DOUBLE) AS match FROM m WHERE match IS NOT NULL ORDER BY match DESC, id LIMIT 1""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    return search.cached_answer(_cache(spark, sf_dir), "Nothing here?", "all", vector(spark, sf_dir, 3), datetime.datetime(2024, 1, 30)).select("id", "cache_key", "match")


@query(f"""WITH {S.CHUNKS} SELECT id, doc_id, coalesce(array_to_string(list(id) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS before, coalesce(array_to_string(list(id) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS after FROM chunks""")
def sibling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    out = expand.siblings(c.select("id", "doc_id"), c)
    return out.select("id", "doc_id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query(f"""WITH {S.CHUNKS}, z AS (SELECT id, section_id, page_number, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM chunks), s AS (SELECT id - id % 100 AS query_id, *, sum(tokens) OVER (PARTITION BY id - id % 100 ORDER BY page_number, id) AS used FROM z WHERE id % 100 < 3),
 k AS (SELECT * FROM s WHERE used <= 8000), sec AS (SELECT DISTINCT section_id, CASE WHEN lang <> 'en' THEN doc_id || '_en' END AS parent FROM chunks),
 w AS (SELECT query_id, section_id, min(near) AS near FROM (SELECT query_id, section_id, 0 AS near FROM s UNION ALL SELECT query_id, parent, 1 FROM s JOIN sec USING (section_id) WHERE parent IS NOT NULL) GROUP BY 1, 2),
 n AS (SELECT w.query_id, z.*, near FROM z JOIN w USING (section_id) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = w.query_id AND k.id = z.id)), m AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY page_number, id) AS used FROM n)
 SELECT query_id, id, 'seed' AS kind, page_number, tokens FROM k UNION ALL SELECT m.query_id, id, CASE near WHEN 0 THEN 'sibling' ELSE 'parent' END, page_number, tokens FROM m WHERE used <= 8000 - coalesce((SELECT sum(tokens) FROM k WHERE k.query_id = m.query_id), 0)""")
def hierarchy_expand_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query (id divisible by 100) has its chunk and the next two as seeds."""
    c = chunks(spark, sf_dir)
    seeds = c.filter("id % 100 < 3").select((F.col("id") - F.col("id") % 100).alias("query_id"), "id")
    sections = c.select("section_id", F.when(F.col("lang") != "en", F.concat("doc_id", F.lit("_en"))).alias("parent_section_id")).distinct()
    return expand.expand(c, seeds, sections)


@query(f"""WITH {S.CHUNKS}, a AS (SELECT page_id AS asset_id, 'src' || page_id % 7 AS doc_id, CASE WHEN page_id % 3 = 0 THEN 'src' || (page_id % 7) || '_en' END AS section_id, CAST(page_id % 40 AS INT) AS page_number FROM pages),
 x AS (SELECT doc_id, section_id, list_sort(list(asset_id)) AS l FROM a WHERE section_id IS NOT NULL GROUP BY 1, 2), y AS (SELECT doc_id, page_number, list_sort(list(asset_id)) AS l FROM a GROUP BY 1, 2)
 SELECT id, coalesce(array_to_string(coalesce(x.l, y.l), ','), '') AS assets FROM chunks c LEFT JOIN x ON c.doc_id = x.doc_id AND c.section_id = x.section_id LEFT JOIN y ON c.doc_id = y.doc_id AND c.page_number = y.page_number""")
def asset_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "pages").select(F.col("page_id").alias("asset_id"), F.concat(F.lit("src"), F.col("page_id") % 7).alias("doc_id"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("src"), F.col("page_id") % 7, F.lit("_en"))).alias("section_id"), (F.col("page_id") % 40).cast("int").alias("page_number"))
    return expand.attach_assets(chunks(spark, sf_dir).select("id", "doc_id", "section_id", "page_number"), assets).select("id", F.array_join("assets", ",").alias("assets"))


_RESULTS = f"r AS (SELECT 0 AS query_id, id, final_score AS score, row_number() OVER (ORDER BY final_score DESC, id) AS rank FROM ({_topics(INCLUDE, [])}))"


def _results(spark, sf_dir):
    found = search.ranked(search.hybrid_topics(chunks(spark, sf_dir, True), vector(spark, sf_dir), TERMS, INCLUDE), "final_score").select("id", F.col("final_score").alias("score"), "rank", F.lit(0).alias("query_id"))
    return found.join(chunks(spark, sf_dir).select("id", "topic", "topics"), "id")


@query(f"""WITH {S.CHUNKS}, {_RESULTS}, j AS (SELECT r.*, topic, topics FROM r JOIN chunks USING (id)) SELECT query_id, count(*) AS n, round(avg(score), 6) AS avg_score, max(score) AS max_score, min(score) AS min_score, round(var_pop(score) FILTER (rank <= 5), 6) AS variance,
 round(count(*) FILTER (rank <= 5 AND list_has_any(coalesce(topics, []), ['graphics', 'hardware'])) / least(5, count(*))::DOUBLE, 6) AS coverage, CAST(len(list_distinct(flatten(list(coalesce(topics, [])) FILTER (rank <= 5)))) AS INT) AS diversity, list(CAST(score AS DOUBLE) ORDER BY rank) FILTER (rank <= 5) AS top_scores FROM j GROUP BY query_id""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.retrieval_metrics(_results(spark, sf_dir), INCLUDE)


@query(f"WITH {S.CHUNKS}, {_RESULTS} SELECT round(avg(coalesce(topic = 'hardware' OR list_contains(topics, 'hardware'), FALSE)::INT), 6) AS contamination FROM r JOIN chunks USING (id) WHERE rank <= 5")
def contamination_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.contamination(_results(spark, sf_dir), "hardware")


@query("SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, source AS document_type, lang AS language, n_chars AS file_size_bytes, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY id DESC LIMIT 20 OFFSET 20")
def list_documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.list_documents(document_index(spark, sf_dir), 2, 20, language="en").select("id", "title", "document_type", "language", "file_size_bytes", "total")


@query(f"""WITH {S.CHUNKS}, f AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS fts_rank FROM (SELECT id, round({S.tf('content', TERMS)}, 6) AS s FROM chunks) WHERE s > 0 ORDER BY s DESC, id LIMIT 20),
 v AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS vector_rank FROM (SELECT id, {S.cos(0)} AS s FROM chunks WHERE embedding IS NOT NULL ORDER BY id LIMIT 100) WHERE s > 0.1 ORDER BY s DESC, id LIMIT 20)
 SELECT coalesce(f.id, v.id) AS id, round(coalesce(0.4::DOUBLE / (60 + fts_rank), 0.0) + coalesce(0.6::DOUBLE / (60 + vector_rank), 0.0), 6) AS score FROM f FULL JOIN v ON f.id = v.id ORDER BY score DESC, 1 LIMIT 10""")
def rrf_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate cap is the feature: the first 100 chunks by id are compared by vector."""
    return search.rrf(chunks(spark, sf_dir, True), vector(spark, sf_dir), TERMS, candidates=100).select("id", "score")


@query(f"WITH {S.CHUNKS} SELECT doc_id, page_number, id, row_number() OVER (ORDER BY doc_id, page_number, id) AS place FROM chunks")
def expanded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's place in the order that an expansion is shown in."""
    return expand.numbered(chunks(spark, sf_dir).select("doc_id", "page_number", "id"), ["doc_id", "page_number", "id"])


@query(f"SELECT page_id AS id, CAST(round({S.tf('t', ['the', 'page'])}, 6) AS DOUBLE) AS score FROM (SELECT page_id, concat_ws(' ', regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), 'shot of the page', url) AS t FROM pages) WHERE {S.all_terms('t', ['the', 'page'])} ORDER BY score DESC, id LIMIT 10")
def keyword_search_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, description and caption of an image are searched together."""
    text_ = F.concat_ws(" ", F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1), F.lit("shot of the page"), "url")
    return search.keyword_search(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text_.alias("t")), "t", ["the", "page"], 10).select("id", "score")


@query(f"""WITH d AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), h AS (SELECT id, len(list_filter(string_split(w, ' '), lambda x: x = 'she')) AS n FROM d WHERE contains(w, ' she ')) SELECT id, CAST(round(n / (n + 1.0), 6) AS DOUBLE) AS score FROM h ORDER BY score DESC, id LIMIT 5""")
def api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the response to a JSON request."""
    from ravine.api import Engine

    return Engine(spark, sf_dir).rows('{"route": "search/keyword", "query": "the she", "top_k": 5}')


def _index(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    return vector_index.build(_chunk_vectors(spark, sf_dir), scratch(spark, "vector-index"))


@query()
def vector_index_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100, through the index: approximate, so without SQL."""
    e = _chunk_vectors(spark, sf_dir)
    return _index(spark, sf_dir).batch(e.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), 10)


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
 FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every list probed: exact."""
    index, e = _index(spark, sf_dir), _chunk_vectors(spark, sf_dir)
    return index.batch(e.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), 10, probes=len(index.centroids))
