"""Providers, state changes, conversations and answers."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.functions import text as T
from ravine.operators import answers, ingest, providers, state, understanding as U
from ravine.plans import sql as S
from ravine.plans.registry import query
from ravine.sources.tables import chunks, document_index, table

_MSG = "m AS (SELECT conv_id AS session_id, turn AS i, role, text AS content FROM conversations)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_index"), "role", F.col("text").alias("content"))


_TERMS = "['system database', 'system db', 'multi-tier', 'supervisor', 'jace', 'station', 'px', 'graphics', 'navigation', 'tag dictionary', 'bacnet', 'modbus', 'lon', 'n2', 'provisioning', 'backup', 'alarm', 'fault', 'schedule', 'sequence', 'ahu', 'vav', 'fcu', 'chiller', 'boiler', 'point', 'control', 'network', 'protocol']"
_MORE = _TERMS[:-1] + ", 'fox', 'niagara', 'tridium', 'workbench', 'web profile']"
#: Letters beyond ASCII are word characters to the engine's patterns; here digits stand for them.
_ASCII = r"regexp_replace({}, '[^\P{{L}}a-zA-Z]', '9', 'g')"
_NAMES = r"list_filter(list_transform(regexp_extract_all(" + _ASCII.format("content") + r", '\b(?:[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*|[A-Z]{2,})\b'), lambda t: lower(t)), lambda t: length(t) > 2)"
_ENTITIES = f"en AS (SELECT session_id, list_sort(list_distinct(flatten(list(list_concat({_NAMES}, list_filter({_TERMS}, lambda t: contains(lower(content), t)))))))[1:20] AS e FROM m GROUP BY session_id)"
_FOLLOW = r"fu AS (SELECT session_id, question, CASE WHEN question IS NULL THEN FALSE ELSE regexp_matches(lower(question), '^(what about|how about|and|also|additionally)') OR regexp_matches(lower(question), '^(can you|could you|please)') OR regexp_matches(lower(question), '\b(that|this|it|they|them)\b') OR regexp_matches(lower(question), '^(more|further|additional)') OR (len(list_filter(string_split_regex(question, '\s+'), lambda w: w <> '')) < 8 AND n > 2) END AS f FROM (SELECT session_id, count(*) AS n, max_by(content, i) FILTER (role = 'user') AS question FROM m GROUP BY 1))"


@query(f"WITH {_MSG}, {_ENTITIES}, {_FOLLOW} SELECT session_id, array_to_string(e, ',') AS entities, f OR len(e) > 10 AS wider, CASE WHEN f AND len(e) > 0 THEN coalesce(question || ' ', '') || array_to_string(e[1:5], ' ') ELSE question END AS query FROM en JOIN fu USING (session_id)")
def convo_enhanced_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    both = U.contexts(m).join(answers.entities(m), "session_id")
    follow = F.col("is_followup")
    return both.select("session_id", F.array_join("entities", ",").alias("entities"), answers.wider_window(F.col("entities"), follow).alias("wider"), answers.enhanced(F.col("question"), F.col("entities"), follow).alias("query"))


@query(f"""WITH {_MSG}, x AS (SELECT session_id, unnest({_NAMES}) AS entity, 1 AS n, FALSE AS term FROM m UNION ALL SELECT session_id, t, CAST((length(lower(content)) - length(replace(lower(content), t, ''))) / length(t) AS BIGINT), TRUE FROM m, (SELECT unnest({_MORE}) AS t) WHERE contains(lower(content), t)),
 c AS (SELECT session_id, entity, CAST(coalesce(sum(n) FILTER (term), sum(n)) AS BIGINT) AS n FROM x GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY n DESC, entity) AS INT) AS rank FROM c QUALIFY rank <= 10""")
def convo_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.frequent_entities(_messages(spark, sf_dir)).select("session_id", "entity", "n", "rank")


@query(f"WITH {_MSG}, p AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY i) AS place FROM m) SELECT session_id, CAST(count(*) AS INT) AS messages, string_agg(upper(role) || ': ' || substring(content, 1, 300), chr(10) ORDER BY place) AS text FROM p WHERE n >= 6 AND place <= n - 4 GROUP BY 1")
def convo_summary_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.summarised(_messages(spark, sf_dir))


_HOPS = f"h AS (SELECT q.vec_id - q.vec_id % 100 AS question_id, CAST(q.vec_id % 100 AS INT) AS hop, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 < CASE WHEN (q.vec_id // 100) % 2 = 0 THEN 4 ELSE 1 END)"


@query(f"""WITH {_HOPS}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id, hop ORDER BY score DESC, id) AS rank, max(hop) OVER (PARTITION BY question_id) AS hops FROM h), k AS (SELECT *, hop * 5 + rank AS place FROM r WHERE hop < 3 AND rank <= CASE WHEN hops > 0 THEN 3 ELSE 5 END),
 o AS (SELECT question_id, id, min(place) AS place, max_by(score, place) AS score FROM k GROUP BY 1, 2) SELECT question_id, id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY place) AS INT) AS position FROM o""")
def multi_hop_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravine.operators import search

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hop = F.col("id") % 100
    asked = e.filter(hop < F.when(F.floor(F.col("id") / 100) % 2 == 0, 4).otherwise(1)).select(F.col("id").alias("query_id"), "embedding")
    lists = search.batch_vector_search(e, asked, 5)
    lists = lists.select((F.col("query_id") - F.col("query_id") % 100).alias("question_id"), (F.col("query_id") % 100).cast("int").alias("hop"), "id", F.col("similarity").alias("score"))
    return answers.multi_hop(lists)


_NEAR = "coalesce(array_to_string(list(substring(translate(content, chr(10), ' '), 1, 200)) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN {} ), '|'), '')"


@query(f"WITH {S.CHUNKS}, s AS (SELECT * FROM chunks WHERE topic IS NOT NULL OR doc_id IN (SELECT doc_id FROM chunks WHERE topic IS NOT NULL)) SELECT id, doc_id, {_NEAR.format('2 PRECEDING AND 1 PRECEDING')} AS before, {_NEAR.format('1 FOLLOWING AND 2 FOLLOWING')} AS after FROM s QUALIFY topic IS NOT NULL")
def sibling_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    out = answers.previews(c.select("doc_id", "id", "content"), c.filter("topic is not null"))
    return out.select("id", "doc_id", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(f"""WITH {S.CHUNKS}, r AS (SELECT page_number AS query_id, row_number() OVER (PARTITION BY page_number ORDER BY id) AS rank, CASE id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'youtube' ELSE 'note' END AS kind, * FROM chunks QUALIFY rank <= 3)
 SELECT query_id, count(*) AS sources, string_agg(chr(10) || '## Source [' || rank || '] - ' || upper(kind) || ': Doc ' || doc_id || chr(10) || CASE kind WHEN 'pdf' THEN '**Page ' || page_number || '**' || chr(10) WHEN 'youtube' THEN '**Timestamp ' || (id // 60) || ':' || lpad(CAST(id % 60 AS VARCHAR), 2, '0') || '**' || chr(10) ELSE '' END || CASE WHEN topics IS NOT NULL THEN '**Section**: ' || array_to_string(topics, ' > ') || chr(10) ELSE '' END || chr(10) || content || chr(10) || chr(10) || repeat('=', 80) || chr(10), '' ORDER BY rank) AS context FROM r GROUP BY 1""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = chunks(spark, sf_dir)
    kind = F.when(F.col("id") % 3 == 0, "pdf").when(F.col("id") % 3 == 1, "youtube").otherwise("note")
    r = c.select(F.col("page_number").alias("query_id"), F.row_number().over(Window.partitionBy("page_number").orderBy("id")).alias("rank"), kind.alias("source_type"), F.concat(F.lit("Doc "), "doc_id").alias("title"), "page_number", F.col("id").alias("at"), F.col("topics").alias("section_path"), "content")
    return answers.source_blocks(r.filter("rank <= 3"))


@query("SELECT user_id AS query_id, url, caption, CAST(n AS INT) AS n FROM (SELECT user_id, 'u' || event_id % 13 AS url, max_by('c' || event_id, event_id) AS caption, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS n FROM events GROUP BY 1, 2) WHERE n <= 10")
def images_once_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    im = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), id_.alias("place"), F.concat(F.lit("u"), id_ % 13).alias("url"), F.concat(F.lit("c"), id_).alias("caption"))
    return answers.once_by_url(im).select("query_id", "url", "caption", "n")


@query("SELECT user_id AS asset_id, min(event_id) AS place, min_by(event_type, event_id) AS kind FROM events GROUP BY 1")
def assets_first_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.first_by_id(table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("place"), F.col("event_type").alias("kind")))


@query("SELECT event_id AS id, value AS score FROM events ORDER BY value DESC, event_id LIMIT 5")
def top_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.citations(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score")))


@query("""WITH a AS (SELECT conv_id * 100 + turn AS answer_id, text AS answer FROM conversations WHERE role = 'assistant'), ci AS (SELECT conv_id * 100 + turn + 1 AS answer_id, text || ' ' || substring(text, 1, 5) AS content FROM conversations WHERE role = 'user' AND turn % 4 = 1 UNION ALL SELECT conv_id * 100 + turn, text FROM conversations WHERE role = 'assistant' AND turn % 4 = 0),
 s AS (SELECT answer_id, list_filter(list_transform(string_split_regex(answer, '[.!?]+'), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))), lambda x: length(x) > 20)[1:20] AS s FROM a), cl AS (SELECT answer_id, unnest(range(len(s))) AS k, unnest(s) AS claim FROM s),
 w AS (SELECT answer_id, k, list_distinct(list_filter(string_split_regex(lower(claim), '[^a-z0-9]+'), lambda t: t <> '')) AS w FROM cl), d AS (SELECT answer_id, list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda t: t <> '')) AS c FROM ci),
 j AS (SELECT w.answer_id, k, max(len(list_intersect(w, coalesce(c, []))) / greatest(len(w), 1)::DOUBLE) >= 0.6 AS ok FROM w LEFT JOIN d USING (answer_id) GROUP BY 1, 2), g AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (ok) AS yes FROM j GROUP BY 1),
 r AS (SELECT a.answer_id, CASE WHEN d.answer_id IS NULL THEN 0 ELSE coalesce(claims, 0) END AS claims, CASE WHEN d.answer_id IS NULL THEN 0 ELSE coalesce(yes, 0) END AS supported, d.answer_id IS NOT NULL AS cited FROM a LEFT JOIN g USING (answer_id) LEFT JOIN (SELECT DISTINCT answer_id FROM d) d ON d.answer_id = a.answer_id),
 z AS (SELECT *, round(CASE WHEN NOT cited THEN 0.0 WHEN claims = 0 THEN 1.0 ELSE supported / claims::DOUBLE END, 6) AS confidence FROM r) SELECT answer_id, claims, supported, CAST(confidence AS DOUBLE) AS confidence, confidence >= 0.85 AS grounded FROM z""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, id_ = table(spark, sf_dir, "conversations"), F.col("conv_id") * 100 + F.col("turn")
    said = c.filter("role = 'assistant'").select(id_.alias("answer_id"), F.col("text").alias("answer"))
    asked = c.filter("role = 'user' and turn % 4 = 1").select((id_ + 1).alias("answer_id"), F.concat_ws(" ", "text", F.substring("text", 1, 5)).alias("content"))
    own = c.filter("role = 'assistant' and turn % 4 = 0").select(id_.alias("answer_id"), F.col("text").alias("content"))
    return answers.verified(said, asked.unionByName(own))


# -- providers -------------------------------------------------------------


@query("SELECT doc_id AS id, " + ", ".join(f"round((length(text) - length(replace(text, '{c}', ''))) / greatest(length(text), 1)::DOUBLE, 9) AS {c}" for c in "aeiou") + " FROM documents")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = providers.embedded(table(spark, sf_dir, "documents"), "text", "doc_id")
    return made.filter("batch <= 100").select("id", *(F.round(F.get("embedding", F.lit(i)), 9).alias(c) for i, c in enumerate("aeiou")))


@query("SELECT d.doc_id AS id, string_split(text, chr(10))[1] || chr(10) || chr(10) || regexp_extract(text, '^([^.!?\\n]*)', 1) AS embedded FROM documents d WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND trim(regexp_extract(text, '^([^.!?\\n]*)', 1), ' ') <> ''")
def summary_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that still need a summary embedding: title, blank line, summary."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.regexp_extract("text", r"^([^.!?\n]*)", 1).alias("summary"))
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return d.join(have, "id", "left_anti").filter(F.trim("summary") != "").select("id", F.concat("title", F.lit("\n\n"), "summary").alias("embedded"))


@query("""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'graphics,hardware' WHEN 1 THEN 'rule' ELSE 'integration' END AS topics FROM documents""")
def topic_tag_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    answer = F.when(k == 0, "Graphics, nonsense , hardware,graphics").when(k == 1, "unheard of").otherwise(" INTEGRATION")
    topics = providers.valid_topics(answer, list(ingest.TOPIC_KEYWORDS), F.array(F.lit("rule")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(topics, ",").alias("topics"))


@query(r"""WITH q AS (SELECT conv_id, turn, text AS q FROM conversations WHERE role = 'user'), p AS (SELECT *, list_filter(list_transform(string_split_regex(q, '\?|\s+and\s+'), lambda s: trim(s, chr(32) || chr(10) || chr(9))), lambda s: length(s) > 0) AS p FROM q)
 SELECT conv_id, turn, array_to_string((CASE WHEN len(p) > 0 THEN p ELSE [q] END)[1:4], '|') AS questions, CASE WHEN turn % 2 = 0 THEN 'one|two' ELSE q END AS variants, CASE WHEN turn % 2 = 0 THEN q ELSE 'a longer rewrite' END AS rewritten FROM p""")
def decompose_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, turn = F.col("text"), F.col("turn")
    given = F.when(turn % 2 == 0, F.array(F.lit("one"), F.lit("two")))
    again = F.when(turn % 2 == 0, "short").otherwise("a longer rewrite")
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(providers.sub_questions(q), "|").alias("questions"), F.array_join(providers.variants(q, given), "|").alias("variants"), providers.rewritten(q, again).alias("rewritten"))


@query("""WITH f AS (SELECT user_id AS query_id, event_id AS id, value AS score, CASE WHEN event_id % 3 = 0 THEN event_id * 7 % 100 / 100.0::DOUBLE END AS rerank FROM events) SELECT query_id, id, score, rerank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC NULLS LAST, score DESC, id) AS INT) AS rank FROM f QUALIFY rank <= 15""")
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    given = f.filter("id % 3 = 0").select("query_id", "id", (F.col("id") * 7 % 100 / 100.0).alias("rerank"))
    return providers.reranked(f, given).select("query_id", "id", "score", "rerank", "rank")


@query("SELECT page_id, page_id || '/images/page_' || printf('%04d', page_id % 12) || '_' || printf('%03d', page_id % 5) || '.png' AS key, CAST(strlen(url) AS INT) AS bytes FROM pages WHERE page_id % 2 = 0")
def object_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a store in the shared folder and read back by key."""
    from ravine.sources.shared import scratch

    id_ = F.col("page_id")
    key = providers.asset_key(id_, "image", (id_ % 12).cast("int"), (id_ % 5).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", key.alias("key"), F.col("url").cast("binary").alias("content"))
    path = scratch(spark, "objects")
    urls = providers.write_objects(rows, path)
    got = providers.read_objects(spark, path, urls.join(rows.filter("page_id % 2 = 0").select("key"), "key", "left_semi"))
    return got.select(F.substring_index("key", "/", 1).cast("long").alias("page_id"), "key", F.length("content").alias("bytes"))


_SECRET = "not a secret"
_PADS = ["".join(f"{b ^ pad:02x}" for b in _SECRET.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"""WITH p AS (SELECT page_id, page_id || '/images/page_' || printf('%04d', page_id % 12) || '_' || printf('%03d', page_id % 5) || '.png' AS key, (page_id * 60 + 3600)::VARCHAR AS until FROM pages)
 SELECT page_id, 'store/' || key || '?expires=' || until || '&signature=' || sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(key || chr(10) || until)))) AS url, page_id * 60 + 3600 >= 9000 AS holds FROM p""")
def object_signed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed links to every page's asset, and whether they hold at a later time."""
    id_ = F.col("page_id")
    key = providers.asset_key(id_, "image", (id_ % 12).cast("int"), (id_ % 5).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", key.alias("key"))
    rows = rows.withColumn("url", providers.signed_url(F.concat(F.lit("store/"), "key"), F.col("key"), _SECRET, id_ * 60))
    return rows.select("page_id", "url", providers.is_signed(F.col("url"), F.col("key"), _SECRET, F.lit(9000)).alias("holds"))


@query("SELECT page_id::VARCHAR AS doc, count(*) AS deleted FROM pages WHERE page_id % 3 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT 'none' || source, 0 FROM documents")
def object_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assets of a third of the documents deleted; documents without assets lose none."""
    from ravine.sources.shared import scratch

    id_, path = F.col("page_id"), scratch(spark, "objects")
    key = providers.asset_key(id_, "image", (id_ % 12).cast("int"), (id_ % 5).cast("int"))
    pages = table(spark, sf_dir, "pages")
    providers.write_objects(pages.select(key.alias("key"), F.col("url").cast("binary").alias("content")), path)
    gone = pages.filter(id_ % 3 == 0).select(id_.cast("string").alias("doc")).unionByName(table(spark, sf_dir, "documents").select(F.concat(F.lit("none"), "source").alias("doc")))
    return providers.delete_objects(spark, path, scratch(spark, "objects"), gone)[1]


# -- state -----------------------------------------------------------------

_ACTION = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'fail' WHEN 'click' THEN 'retry' WHEN 'purchase' THEN 'complete' ELSE CASE WHEN event_id % 2 = 0 THEN 'cancel' ELSE 'resume' END END"
_OK = "(e.action = 'start' AND f.status = 'queued') OR (e.action IN ('complete', 'fail') AND f.status = 'processing') OR (e.action = 'cancel' AND f.status IN ('queued', 'processing')) OR (e.action = 'retry' AND f.status = 'failed' AND f.retries < 3) OR (e.action = 'resume' AND f.status IN ('failed', 'cancelled'))"


@query(f"""WITH RECURSIVE e AS (SELECT user_id % 40 AS job_id, event_id, {_ACTION} AS action, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS r FROM events),
 f AS (SELECT job_id, 0 AS r, 0::BIGINT AS event_id, '' AS action, FALSE AS accepted, 'queued' AS status, 0 AS retries FROM (SELECT DISTINCT job_id FROM e) UNION ALL
 SELECT e.job_id, e.r, e.event_id, e.action, {_OK}, CASE WHEN {_OK} THEN CASE e.action WHEN 'start' THEN 'processing' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled' ELSE 'queued' END ELSE f.status END, f.retries + CASE WHEN ({_OK}) AND e.action = 'retry' THEN 1 ELSE 0 END FROM f JOIN e ON e.job_id = f.job_id AND e.r = f.r + 1)
 SELECT job_id, event_id, action, accepted, status, CAST(retries AS INT) AS retries FROM f WHERE r > 0""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, id_ = F.col("event_type"), F.col("event_id")
    action = F.when(kind == "signup", "start").when(kind == "view", "fail").when(kind == "click", "retry").when(kind == "purchase", "complete").when(id_ % 2 == 0, "cancel").otherwise("resume")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("job_id"), id_.alias("at"), id_.alias("event_id"), action.alias("action"))
    return state.transitions(e).drop("at")


_CACHE = "c AS (SELECT conv_id AS cache_key, 'doc' || conv_id % 5 AS doc, conv_id % 4 AS hit_count, TIMESTAMP '2024-01-30' - to_days(CAST(conv_id % 12 AS INT)) AS created_at FROM (SELECT DISTINCT conv_id FROM conversations))"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select(F.col("conv_id").alias("cache_key"), F.concat(F.lit("doc"), F.col("conv_id") % 5).alias("doc"), (F.col("conv_id") % 4).alias("hit_count"), F.expr("timestamp_ntz'2024-01-30' - make_dt_interval(cast(conv_id % 12 as int))").alias("created_at"))


@query(f"WITH {_CACHE}, h AS (SELECT user_id AS cache_key, count(*) AS n FROM events GROUP BY 1) SELECT cache_key, hit_count AS hit_count_before, hit_count + coalesce(n, 0) AS hit_count FROM c LEFT JOIN h USING (cache_key)")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("cache_key"))
    return state.with_hits(_cache(spark, sf_dir), hits).select("cache_key", "hit_count_before", "hit_count")


@query(f"WITH {_CACHE} SELECT cache_key, doc, created_at FROM c WHERE doc <> 'doc2' AND created_at >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def cache_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = state.cleaned(state.without_document(_cache(spark, sf_dir), "doc2"), datetime.datetime(2024, 1, 30))
    return kept.select("cache_key", "doc", "created_at")


@query(f"WITH {_CACHE} SELECT count(*) FILTER (created_at < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS deleted, count(*) FILTER (created_at >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS kept FROM c")
def cache_cleanup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cleaned(_cache(spark, sf_dir), datetime.datetime(2024, 1, 30))[1]


@query("SELECT doc_id AS id, substring(text, 1, 500) AS question FROM documents")
def analytics_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.logged(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question")))


@query("SELECT p_partkey AS id, ' ' || trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '([a-z]{3,})ing([^a-z0-9]|$)', '\\1\\2', 'g'), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ' AS fts FROM part".replace("lower(p_name || ' ' || p_type)", "regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '([a-z]{2,})sses([^a-z0-9]|$)', '\\1ss\\2', 'g'), '([a-z]{2,})ies([^a-z0-9]|$)', '\\1y\\2', 'g'), '([a-z]{2,}[b-hj-np-rtv-z])s([^a-z0-9]|$)', '\\1\\2', 'g')").replace("SELECT p_partkey AS id, ' ' || trim(regexp_replace(", "SELECT p_partkey AS id, ' ' || trim(regexp_replace(regexp_replace(", 1).replace("'\\1\\2', 'g'), '[^a-z0-9]+'", "'\\1\\2', 'g'), '([a-z]{3,})ed([^a-z0-9]|$)', '\\1\\2', 'g'), '[^a-z0-9]+'"))
def fts_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.searchable(table(spark, sf_dir, "part"), "p_name", "p_type").select(F.col("p_partkey").alias("id"), "fts")


@query("""WITH o AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id + 1000000 AS id, sha256(text) AS h FROM documents WHERE doc_id % 3 = 0),
 a AS (SELECT 'reject' AS mode, id FROM o UNION ALL SELECT 'reject', id FROM n WHERE h NOT IN (SELECT h FROM o)), b AS (SELECT 'reload' AS mode, id FROM o WHERE h NOT IN (SELECT h FROM n) UNION ALL SELECT 'reload', id FROM n) SELECT * FROM a UNION ALL SELECT * FROM b""")
def ingest_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir).select("id", "file_hash")
    old, new = index.filter("id % 2 = 0"), index.filter("id % 3 = 0").withColumn("id", F.col("id") + 1000000)
    modes = [state.reloaded(old, new, again).select(F.lit(name).alias("mode"), "id") for name, again in (("reject", False), ("reload", True))]
    return modes[0].unionByName(modes[1])


@query("SELECT page_id AS asset_id, 'old' AS origin FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'new' FROM pages WHERE page_id % 3 <> 0")
def append_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "pages").select(F.col("page_id").alias("asset_id"))
    return state.with_assets(a.filter("asset_id % 3 = 0").withColumn("origin", F.lit("old")), a.withColumn("origin", F.lit("new")))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 IN (0, 2) THEN 'https://x/' || doc_id END AS link FROM documents")
def csv_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.when(id_ % 4 == 0, F.concat(id_, F.lit(",https://x/"), id_)).when(id_ % 4 == 1, F.concat(id_, F.lit(","))).when(id_ % 4 == 2, F.concat(F.lit(" "), id_, F.lit(" , https://x/"), id_)).otherwise(F.concat(F.lit(" ,https://y/"), id_)).alias("line"))
    return state.linked(d.select(id_.alias("id")), lines)


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents GROUP BY 1")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as JSON and read back."""
    from ravine.sources import tables
    from ravine.sources.shared import scratch

    path = scratch(spark, "report")
    report = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("characters"))
    tables.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("SELECT vec_id AS id, array_to_string(['system_database', 'multi_tier_architecture'], ',') AS topics FROM embeddings WHERE label % 2 = 0 UNION ALL SELECT vec_id, 'graphics' FROM embeddings WHERE label % 2 = 1")
def category_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = F.when(F.col("label") % 2 == 0, F.array(F.lit("architecture"), F.lit("architecture"))).otherwise(F.array(F.lit("graphics"), F.lit("nothing")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array_join(U.topics_of(cats), ",").alias("topics"))


@query("SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INT) AS words FROM conversations")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.word_count("text").alias("words"))
