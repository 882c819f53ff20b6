"""Reads by key, page, section and time, formatters and the search grammar."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.functions import formats, grammar
from ravine.operators import lookup, search
from ravine.plans import sql as S
from ravine.plans.registry import query
from ravine.sources.tables import chunks, document_index, table

#: Assets of chunks: pages with a document, a page and, for a third of them, a section.
_ASSETS = "assets AS (SELECT page_id AS asset_id, 'src' || (page_id % 7) AS doc_id, CAST(page_id % 40 AS INT) AS page_number, CASE WHEN page_id % 3 = 0 THEN 'src' || (page_id % 7) || '_en' END AS section_id, url, html FROM pages)"


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit("src"), F.col("page_id") % 7)
    section = F.when(F.col("page_id") % 3 == 0, F.concat(doc, F.lit("_en")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("asset_id"), doc.alias("doc_id"), (F.col("page_id") % 40).cast("int").alias("page_number"), section.alias("section_id"), "url", "html")


@query("SELECT doc_id AS id, source AS document_type, lang AS language, sha256(text) AS file_hash, n_chars AS file_size_bytes FROM documents WHERE doc_id = 42")
def document_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.details(document_index(spark, sf_dir), 42).select("id", "document_type", "language", "file_hash", "file_size_bytes")


@query(f"WITH {S.CHUNKS} SELECT id, page_number, section_id, topic FROM chunks WHERE id IN (SELECT conv_id FROM conversations)")
def chunks_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    return lookup.chunks_by_ids(chunks(spark, sf_dir), ids).select("id", "page_number", "section_id", "topic")


_STATUS = "CASE WHEN n_chars % 4 = 0 THEN 'processing' ELSE 'completed' END"


@query(f"WITH {S.CHUNKS}, d AS (SELECT doc_id AS id, {_STATUS} AS status, lang AS language FROM documents) SELECT c.id, c.doc_id AS source, d.language FROM chunks c JOIN d ON c.id = d.id WHERE status = 'completed'")
def chunks_with_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_index(spark, sf_dir).withColumn("status", F.when(F.col("file_size_bytes") % 4 == 0, "processing").otherwise("completed"))
    c = chunks(spark, sf_dir).select("id", F.col("doc_id").alias("source"))
    return lookup.with_document(c, docs, "language", key="id").select("id", "source", "language")


@query("WITH s AS (SELECT o_custkey AS doc_id, 'sec' || o_custkey AS section_id, list(o_orderkey) AS ids FROM orders GROUP BY o_custkey) SELECT o.o_custkey AS doc_id, o.o_orderkey AS id, s.section_id FROM orders o JOIN s ON s.doc_id = o.o_custkey AND list_contains(s.ids, o.o_orderkey)")
def section_of_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"))
    sections = o.groupBy("doc_id").agg(F.collect_list("id").alias("chunk_ids")).withColumn("section_id", F.concat(F.lit("sec"), "doc_id"))
    return lookup.sections_of_chunks(sections, o)


_COVER = "s AS (SELECT page_id % 10 AS doc_id, 'sec' || CAST(floor(page_id / 10) AS INT) AS section_id, CAST(floor(page_id / 10) AS INT) AS start_page, CAST(floor(page_id / 10) AS INT) + CAST(page_id % 5 AS INT) AS end_page FROM pages), g AS (SELECT DISTINCT doc_id, start_page AS page_no FROM s)"


@query(f"WITH {_COVER} SELECT g.doc_id, g.page_no, section_id, start_page, end_page FROM g JOIN s ON s.doc_id = g.doc_id AND g.page_no BETWEEN start_page AND end_page")
def sections_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.col("page_id") / 10).cast("int")
    s = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("doc_id"), F.concat(F.lit("sec"), at).alias("section_id"), at.alias("start_page"), (at + (F.col("page_id") % 5).cast("int")).alias("end_page"))
    return lookup.covering_sections(s.select("doc_id", F.col("start_page").alias("page_no")).distinct(), s)


@query(f"WITH {S.CHUNKS}, {_ASSETS} SELECT c.id, a.asset_id FROM chunks c JOIN (SELECT * FROM assets QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY asset_id) <= 5) a ON a.doc_id = c.doc_id AND a.page_number = c.page_number")
def images_for_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.assets_of_chunks(chunks(spark, sf_dir).select("id", "doc_id", "page_number"), _assets(spark, sf_dir)).select("id", "asset_id")


@query(f"WITH {_ASSETS} SELECT asset_id, page_number, url FROM assets WHERE doc_id = 'src1' AND page_number IN (1, 2, 8, 15, 22) ORDER BY page_number, asset_id LIMIT 10")
def images_by_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.assets_by_pages(_assets(spark, sf_dir), "src1", [1, 2, 8, 15, 22]).select("asset_id", "page_number", "url")


@query(f"WITH {_ASSETS} SELECT asset_id, page_number, url FROM assets WHERE doc_id = 'src2'")
def images_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.assets_by_pages(_assets(spark, sf_dir), "src2", k=None).select("asset_id", "page_number", "url")


@query(f"WITH {_ASSETS} SELECT asset_id, section_id, page_number FROM assets WHERE doc_id = 'src3' AND (section_id IN ('src3_en', 'src3_de') OR page_number IN (3, 10))")
def assets_on_pages_or_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.on_pages_or_sections(_assets(spark, sf_dir), "src3", ["src3_en", "src3_de"], [3, 10]).select("asset_id", "section_id", "page_number")


@query(f"WITH {_ASSETS} SELECT asset_id, doc_id, page_number, section_id, url FROM assets WHERE doc_id IN ('src0', 'src3') AND (section_id IN ('src3_en') OR section_id IS NULL)")
def assets_in_sections_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.in_sections_or_none(_assets(spark, sf_dir), ["src0", "src3"], ["src3_en"], url=True, html=False)


@query(f"WITH {_ASSETS} SELECT asset_id, coalesce(section_id, CASE WHEN asset_id % 2 = 0 THEN 'idx' || asset_id END) AS section_id FROM assets")
def asset_section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assets(spark, sf_dir).select("asset_id", "section_id")
    index = a.filter("asset_id % 2 = 0").select("asset_id", F.concat(F.lit("idx"), "asset_id").alias("section_id"))
    return lookup.section_of_asset(a, index).select("asset_id", "section_id")


_SHOTS = "e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS t, event_type FROM events)"


def _shots(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select(F.col("event_id").alias("asset_id"), F.col("user_id").alias("doc_id"), at.alias("at"))


@query(f'WITH {_SHOTS} SELECT event_id AS asset_id, t AS "at" FROM e WHERE event_type = \'click\' AND t >= 86400 AND t <= 200000')
def screenshots_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shots(spark, sf_dir, "click").filter(lookup.between("at", 86400, 200000)).select("asset_id", "at")


@query(f'WITH {_SHOTS}, s AS (SELECT event_id AS span_id, user_id, t AS a, t + 3600 AS z FROM e WHERE event_type = \'view\') SELECT span_id, n, asset_id, "at" FROM (SELECT span_id, row_number() OVER (PARTITION BY span_id ORDER BY t, event_id) AS n, event_id AS asset_id, t AS "at" FROM s JOIN e ON e.user_id = s.user_id AND event_type = \'click\' AND t BETWEEN a - 2 AND z + 2) WHERE n <= 3')
def screenshots_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _shots(spark, sf_dir, "view").select(F.col("asset_id").alias("span_id"), "doc_id", F.col("at").alias("start_s"), (F.col("at") + 3600).alias("end_s"))
    return lookup.first_around(spans, _shots(spark, sf_dir, "click"), width=3600)


_VISIBLE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'processing' WHEN 'signup' THEN 'queued' ELSE 'cancelled' END"


@query(f"SELECT event_id AS id, {_VISIBLE} AS status, ts AS updated_at FROM events WHERE event_type IN ('signup', 'view') OR ts > TIMESTAMP '2024-01-29 23:00:00' - INTERVAL 5 MINUTE")
def jobs_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "completed").when(kind == "view", "processing").when(kind == "signup", "queued").otherwise("cancelled")
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("updated_at"))
    return lookup.visible_jobs(jobs, datetime.datetime(2024, 1, 29, 23))


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.embedding IS NULL AND length(trim(text, ' ')) > 0")
def documents_without_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lacking(chunks(spark, sf_dir), "embedding", given="content").select("id")


@query("SELECT name FROM (VALUES ('k'), ('timestamp_start'), ('source_type')) v(name) WHERE name NOT IN (SELECT unnest(json_keys(props)) FROM events)")
def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are expected and that no row's properties have."""
    return lookup.missing_names(table(spark, sf_dir, "events"), "props", "k", "timestamp_start", "source_type")


@query("SELECT name, v.value, count(event_id) AS n FROM (SELECT 'queued' AS name, 'view' AS value UNION SELECT 'failed', 'error' UNION SELECT 'never', 'nothing') v LEFT JOIN events ON event_type = v.value GROUP BY 1, 2")
def literal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of literals, and how many rows have each value."""
    found = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return lookup.literals(spark, queued="view", failed="error", never="nothing").join(found, "value", "left").select("name", "value", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id, CASE WHEN s // 3600 > 0 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS clock,"
       " CASE WHEN s = 0 THEN '0s' ELSE array_to_string(list_filter([CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'h' END, CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm' END, CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END], lambda x: x IS NOT NULL), ' ') END AS spelled,"
       " CASE WHEN b >= 1073741824 THEN regexp_replace(CAST(round(b / 1073741824.0::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' GB' WHEN b >= 1048576 THEN regexp_replace(CAST(round(b / 1048576.0::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' MB' WHEN b >= 1024 THEN regexp_replace(CAST(round(b / 1024.0::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' KB' ELSE b || ' Bytes' END AS size,"
       " '$' || regexp_replace(format('{:,.4f}', round(value, 4)), '0{1,2}$', '') AS price, printf('%.0f', round(value)) || '%' AS share, 'https://x/watch?v=' || event_id || '&t=' || s || 's' AS url FROM (SELECT event_id, value, event_id * 7 % 9000 AS s, event_id * event_id * 13 AS b FROM events)")
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, id_ = F.col("event_id") * 7 % 9000, F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", formats.clock(s).alias("clock"), formats.spelled(s).alias("spelled"), formats.file_size(id_ * id_ * 13).alias("size"), formats.currency("value").alias("price"), formats.percentage("value").alias("share"), formats.timestamp_url(F.concat(F.lit("https://x/watch?v="), id_), s).alias("url"))


@query("""WITH p AS (SELECT page_id, url, 'My file (' || page_id || ').v2.pdf' AS file, 'https://www.youtube.com/watch?v=' || lpad(CAST(page_id AS VARCHAR), 11, 'a') || '&x=1' AS video, CASE WHEN page_id % 2 = 0 THEN 'https://drive.google.com/file/d/F' || page_id || '/view' ELSE 'https://drive.google.com/open?id=G' || page_id || '&usp=x' END AS drive, 'see FIG. ' || page_id || '.' || (page_id % 9) || ' and Table ' || page_id AS caption FROM pages)
 SELECT page_id, 'My_file__' || page_id || '__v2_' || substring(sha256(file), 1, 8) AS slug, lpad(CAST(page_id AS VARCHAR), 11, 'a') AS video, CASE WHEN page_id % 2 = 0 THEN 'F' ELSE 'G' END || page_id AS drive, 'Fig. ' || page_id || '.' || (page_id % 9) AS figure, 'Table ' || page_id AS tbl, CAST(NULL AS VARCHAR) AS image, 'https://img.youtube.com/vi/' || page_id || '/maxresdefault.jpg' AS thumb FROM p""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("My file ("), id_, F.lit(").v2.pdf")).alias("file"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(id_.cast("string"), 11, "a"), F.lit("&x=1")).alias("video"),
        F.when(id_ % 2 == 0, F.concat(F.lit("https://drive.google.com/file/d/F"), id_, F.lit("/view"))).otherwise(F.concat(F.lit("https://drive.google.com/open?id=G"), id_, F.lit("&usp=x"))).alias("drive"),
        F.concat(F.lit("see FIG. "), id_, F.lit("."), id_ % 9, F.lit(" and Table "), id_).alias("caption"),
    )
    return p.select("page_id", formats.slug("file").alias("slug"), formats.video_id("video").alias("video"), formats.drive_id("drive").alias("drive"), formats.asset_number("caption", "figure").alias("figure"), formats.asset_number("caption", "table").alias("tbl"), formats.asset_number("caption", "image").alias("image"), formats.thumbnail_url(F.concat(F.lit("video_"), id_)).alias("thumb"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))), lambda x: length(x) > 20)[1:20] AS s FROM documents) SELECT doc_id, CAST(len(s) AS INT) AS n, array_to_string(s, '|') AS sentences FROM s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", formats.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.array_join("s", "|").alias("sentences"))


@query("""SELECT conv_id, turn, trim(text, chr(32) || chr(10)) AS plain, 'About ' || turn AS description, 'one ' || turn || '|two' AS insights, CASE WHEN turn % 2 = 0 THEN 'diagram=Wires ' || turn || '|' ELSE '' END || 'unknown=' || CASE WHEN turn % 2 = 0 THEN '' ELSE '|unknown=' END AS summaries, CASE WHEN turn % 3 = 0 THEN 'a,b' ELSE '' END AS cells FROM conversations""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, turn = table(spark, sf_dir, "conversations"), F.col("turn")
    fenced = F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))
    analysis = F.concat(F.lit("DESCRIPTION: About "), turn, F.lit("\nother\nINSIGHTS:\n- one "), turn, F.lit("\nskip\n - two"))
    batch = F.when(turn % 2 == 0, F.concat(F.lit("Type: Diagram\nSummary: Wires "), turn)).otherwise("nothing")
    cells = F.when(turn % 3 == 0, '[["a","b"]]').otherwise("{broken")
    described, insights = formats.table_analysis(analysis)
    first = F.get(formats.json_or(cells, "array<array<string>>", F.array().cast("array<array<string>>")), F.lit(0))
    summaries = F.transform(formats.batch_summaries(batch, 2), lambda x: F.concat(x["type"], F.lit("="), x["summary"]))
    return c.select("conv_id", "turn", formats.without_quotes(F.concat(F.lit('"'), formats.without_fence(fenced), F.lit('"'))).alias("plain"), described.alias("description"), F.array_join(insights, "|").alias("insights"), F.array_join(summaries, "|").alias("summaries"), F.coalesce(F.array_join(first, ","), F.lit("")).alias("cells"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS m FROM embeddings), b AS (SELECT vec_id, v, list_transform(v, lambda x: CASE WHEN x > m THEN 1 ELSE 0 END) AS b FROM p)
 SELECT vec_id, ltrim(array_to_string(list_transform(range(0, 16), lambda k: substring('0123456789abcdef', (b[4 * k + 1] * 8 + b[4 * k + 2] * 4 + b[4 * k + 3] * 2 + b[4 * k + 4] + 1)::BIGINT, 1)), ''), '0') AS hash, round(least(1.0::DOUBLE, list_var_pop(v) / 10000), 9) AS complexity FROM b""")
def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", formats.average_hash("embedding").alias("hash"), F.round(formats.complexity("embedding"), 9).alias("complexity"))


_STEMS = "lower(text)"
for _pattern, _kept in grammar.ENDINGS:
    _STEMS = f"regexp_replace({_STEMS}, '{_pattern}', '{_kept.replace('$', chr(92))}', 'g')"
_WORDS = f"' ' || trim(regexp_replace({_STEMS}, '[^a-z0-9]+', ' ', 'g'), ' ') || ' '"


@query(f"""WITH d AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), h AS (SELECT id, len(list_filter(string_split(w, ' '), lambda x: x IN ('system', 'she'))) AS n FROM d WHERE contains(w, ' system ') OR (contains(w, ' she ') AND NOT contains(w, ' of the ')))
 SELECT id, CAST(round(n / (n + 1.0), 6) AS DOUBLE) AS score FROM h ORDER BY score DESC, id LIMIT 20""")
def keyword_search_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.web_search(chunks(spark, sf_dir), "content", 'the systems OR she -"of the"').select("id", "score")


@query("SELECT p_partkey AS id, p_name AS title FROM part WHERE list_contains(string_split(p_type, ' '), 'STEEL') OR p_name ILIKE '%ring%'")
def documents_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.to_json(F.split("p_type", " ")).alias("tags"))
    return p.filter(search.tagged("tags", "STEEL") | F.col("title").ilike("%ring%")).select("id", "title")
