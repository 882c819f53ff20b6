"""Parsed documents and videos over pages, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.operators import expand, folds, ingest, pipeline, recursion, structure
from ravine.plans.registry import query
from ravine.sources.tables import table

_LABEL = "CASE page_id % 6 WHEN 0 THEN 'Title' WHEN 1 THEN 'section-2-x' WHEN 2 THEN 'Heading' WHEN 3 THEN 'text' WHEN 4 THEN 'list-3' ELSE 'heading-12-4' END"
_EL = "el AS (SELECT doc_id, CAST(i - 1 AS INT) AS idx, trim(l[i], ' ') AS text, CAST(floor((i - 1) / 5.0) AS INT) AS page_no, (i - 1) % 9 = 4 AS header FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE length(trim(l[i], ' ')) > 0)"


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as elements; every ninth is a header."""
    e = ingest.elements(table(spark, sf_dir, "documents"))
    return e.withColumn("type", F.when(F.col("idx") % 9 == 4, "section_header").otherwise("text"))


def _labels(column: str = "page_id"):
    k = F.col(column) % 6
    return F.when(k == 0, "Title").when(k == 1, "section-2-x").when(k == 2, "Heading").when(k == 3, "text").when(k == 4, "list-3").otherwise("heading-12-4")


@query(f"SELECT page_id AS doc_id, {_LABEL} AS label, CASE page_id % 6 WHEN 3 THEN 'text' WHEN 4 THEN 'text' ELSE 'section_header' END AS type, CAST(CASE page_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 12 ELSE 99 END AS INT) AS level FROM pages WHERE page_id % 11 <> 0 AND page_id % 7 <> 0")
def element_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("page_id")
    items = table(spark, sf_dir, "pages").select(id_.alias("doc_id"), _labels().alias("label"), F.when(id_ % 11 != 0, 1).alias("page_no"), F.when(id_ % 7 == 0, " ").otherwise("words").alias("text"))
    return structure.typed_elements(items).select("doc_id", "label", "type", "level")


@query("SELECT page_id AS doc_id, 0 AS idx, CAST(page_id % 9 AS INT) AS page_no, 'Shot ' || page_id || ' of a page' AS caption, CAST(strlen(url) AS INT) AS bytes FROM pages")
def picture_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.struct(F.base64(F.col("url").cast("binary")).alias("image"), F.array(F.concat(F.lit("Shot "), "page_id"), F.lit("of a page")).alias("captions"), (F.col("page_id") % 9).cast("int").alias("page_no"))
    return structure.pictures(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.to_json(F.array(p)).alias("pictures")))


@query("""SELECT r_regionkey AS doc_id, 0 AS idx, r_regionkey AS page_no, CAST(count(*) + 1 AS INT) AS n_rows, 2 AS n_columns, '| name | key |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |' || chr(10), '' ORDER BY n_nationkey) AS markdown FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def table_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    cells = F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), F.transform("n", lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string"))))
    docs = n.select(F.col("n_regionkey").alias("doc_id"), F.to_json(F.array(F.struct(cells.alias("cells"), F.col("n_regionkey").alias("page_no")))).alias("tables"))
    return structure.tables(docs)


@query("""WITH r AS (SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region), n AS (SELECT n.n_name, r.i, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS j FROM nation n JOIN r ON n_regionkey = r_regionkey)
 SELECT 0 AS doc_id, printf('%04d.', i) AS place, r_name AS title, 1 AS level, CAST(r_regionkey + 2 AS INT) AS page FROM r UNION ALL SELECT 0, printf('%04d.%04d.', i, j), n_name, 2, 1 FROM n""")
def bookmark_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("title"))).alias("children"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    top = r.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", F.col("r_name").alias("title"), (F.col("r_regionkey") + 2).alias("page"), "children"))).alias("o"))
    return recursion.outline(top.select(F.lit(0).alias("doc_id"), F.to_json(F.transform("o", lambda x: F.struct(x["title"].alias("title"), x["page"].alias("page"), x["children"].alias("children")))).alias("outline")))


@query("SELECT event_id, event_id % 1200 + user_id % 3 * 1200 AS start_s, event_id % 1200 + 5 + user_id % 3 * 1200 AS end_s FROM events")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id") % 1200
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("part"), at.alias("start_s"), (at + 5).alias("end_s"))
    return structure.joined_parts(e).select("event_id", "start_s", "end_s")


def _toc(spark: SparkSession, sf_dir: str):
    h1 = F.trim(F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1))
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("doc_id"), F.floor(F.col("page_id") / 10).cast("int").alias("idx"), h1.alias("title"))
    marks = p.filter("idx % 2 = 0").select("doc_id", "idx", F.when(F.col("idx") % 4 == 0, F.upper("title")).otherwise(F.concat(F.lit("Part "), F.element_at(F.split("title", " "), 1))).alias("title"), (F.col("idx") % 3 + 1).alias("level"), F.lit(99).alias("page"))
    return marks, p.filter("idx % 3 <> 1").select("doc_id", "idx", "title", F.col("idx").alias("page"))


@query()
def bookmark_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy one-to-one match has no SQL; tested against a plain loop."""
    marks, headings = _toc(spark, sf_dir)
    return structure.outline_sections(marks, headings)


@query(f"""WITH RECURSIVE {_EL}, x AS (SELECT *, count(*) OVER (PARTITION BY doc_id, text) AS often FROM el), sec AS (SELECT doc_id, page_no, text, 'sec_' || idx AS sid FROM el WHERE idx % 18 = 4),
 y AS (SELECT x.doc_id, x.idx, x.page_no, x.header, x.text, CASE WHEN x.header THEN a.sid ELSE b.sid END AS sid FROM x LEFT JOIN sec a ON x.header AND a.doc_id = x.doc_id AND a.page_no = x.page_no AND a.text = x.text LEFT JOIN sec b ON NOT x.header AND b.doc_id = x.doc_id AND b.page_no = x.page_no
       WHERE x.header OR NOT (length(x.text) < 30 OR regexp_matches(x.text, '(?i)^.+\\.(docx?|pdf)$') OR regexp_matches(x.text, '(?i)^(page|p\\.?)\\s*\\d+\\s*$') OR (length(x.text) < 60 AND often > 3))),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, idx) AS r FROM y),
 f AS (SELECT doc_id, r, sid AS cur, sid AS of_, page_no AS page, CASE WHEN header THEN CASE WHEN sid IS NULL THEN '' ELSE '## ' || text END ELSE text END AS t, CASE WHEN header AND sid IS NULL THEN 0 WHEN header THEN length(text) + 3 ELSE length(text) END AS size, CASE WHEN header AND sid IS NULL THEN 0 ELSE 1 END AS n, 0 AS g, NOT header AND length(text) >= 1200 AS full, page_no AS last_page FROM o WHERE r = 1
  UNION ALL SELECT o.doc_id, o.r, CASE WHEN o.header THEN coalesce(o.sid, f.cur) ELSE coalesce(f.cur, o.sid) END, CASE WHEN o.header THEN coalesce(o.sid, f.of_) ELSE coalesce(f.of_, f.cur, o.sid) END,
   CASE WHEN o.header AND o.sid IS NOT NULL THEN o.page_no WHEN f.full THEN f.last_page ELSE f.page END,
   CASE WHEN o.header THEN CASE WHEN o.sid IS NULL THEN '' ELSE '## ' || o.text END WHEN f.full OR f.n = 0 THEN o.text ELSE f.t || ' ' || o.text END,
   CASE WHEN o.header THEN CASE WHEN o.sid IS NULL THEN 0 ELSE length(o.text) + 3 END WHEN f.full THEN length(o.text) ELSE f.size + length(o.text) END,
   CASE WHEN o.header THEN CASE WHEN o.sid IS NULL THEN 0 ELSE 1 END WHEN f.full THEN 1 ELSE f.n + 1 END, CASE WHEN o.header THEN f.g + 2 WHEN f.full THEN f.g + 1 ELSE f.g END,
   NOT o.header AND CASE WHEN f.full THEN length(o.text) ELSE f.size + length(o.text) END >= 1200, o.page_no FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1),
 c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY r DESC) = 1)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INT) AS chunk_no, page AS page_no, of_ AS section_id, CAST(n AS INT) AS n_elements, CAST(length(t) AS INT) AS length, t AS text FROM c WHERE length(t) >= 150""")
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _elements(spark, sf_dir)
    sections = e.filter("idx % 18 = 4").select("doc_id", F.concat(F.lit("sec_"), "idx").alias("section_id"), F.col("page_no").alias("start_page"), F.col("page_no").alias("end_page"), F.lit(1).alias("level"), "idx", F.trim("text").alias("title"), F.lit("").alias("number"))
    return structure.chunk_elements(e, sections)


@query(f"""WITH {_EL}, w AS (SELECT doc_id, page_no, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 4 AND regexp_matches(x, '^\\p{{L}}+$') AND x NOT IN ('about', 'there', 'their', 'where', 'which', 'these', 'those'))) AS w FROM el),
 k AS (SELECT doc_id, page_no, list_sort(list_distinct(list(w)))[1:5] AS k FROM w GROUP BY 1, 2), c AS (SELECT doc_id, page_no, count(*) AS chunk_count FROM el WHERE idx % 3 = 0 GROUP BY 1, 2),
 a AS (SELECT page_id % 50 AS doc_id, CAST(page_id % 4 AS INT) AS page_no, count(*) FILTER (page_id % 2 = 0) AS i, count(*) FILTER (page_id % 2 = 1) AS t FROM pages GROUP BY 1, 2),
 s AS (SELECT DISTINCT doc_id, 's' || idx AS sid, unnest([page_no, page_no + 1]) AS page_no FROM el WHERE idx % 10 = 0), z AS (SELECT doc_id, page_no, list_sort(list(sid)) AS s FROM s GROUP BY 1, 2)
 SELECT c.doc_id, c.page_no, chunk_count, coalesce(array_to_string(k, ','), '') AS key_topics, coalesce(i, 0) AS image_count, coalesce(i, 0) > 0 AS has_images, coalesce(t, 0) AS table_count, coalesce(t, 0) > 0 AS has_tables, coalesce(array_to_string(z.s, ','), '') AS section_ids
 FROM c LEFT JOIN k USING (doc_id, page_no) LEFT JOIN a USING (doc_id, page_no) LEFT JOIN z USING (doc_id, page_no)""")
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, id_ = _elements(spark, sf_dir), F.col("page_id")
    assets = table(spark, sf_dir, "pages").select((id_ % 50).alias("doc_id"), (id_ % 4).cast("int").alias("page_no"), F.when(id_ % 2 == 0, "image").otherwise("table").alias("kind"))
    sections = e.filter("idx % 10 = 0").select("doc_id", F.concat(F.lit("s"), "idx").alias("section_id"), F.col("page_no").alias("start_page"), (F.col("page_no") + 1).alias("end_page"))
    out = structure.page_index(e, e.filter("idx % 3 = 0").select("doc_id", "page_no"), assets, sections)
    return out.withColumns({c: F.array_join(c, ",") for c in ("key_topics", "section_ids")})


_IMAGES = "im AS (SELECT user_id AS doc_id, event_id AS idx, CAST(event_id * 37 % 400 AS INT) AS width, CAST(event_id * 91 % 300 AS INT) AS height, 'h' || event_id % 3 AS hash, event_id % 6 AS k, event_id % 10 / 20.0 AS complexity FROM events)"
_JUDGED = _IMAGES + """, j AS (SELECT *, width >= 80 AND height >= 80 AND greatest(width, height) <= 5 * least(width, height) AS ok FROM im), q AS (SELECT *, sum(ok::INT) OVER (PARTITION BY doc_id, hash ORDER BY idx) AS seen, width >= 150 AND height >= 150 AS large FROM j),
 r AS (SELECT doc_id, idx, hash, CASE WHEN width < 80 OR height < 80 THEN 'too_small' WHEN NOT ok THEN 'extreme_ratio' WHEN seen > 3 THEN 'repeated' WHEN k = 1 THEN 'decorative' WHEN k IN (2, 3) THEN CASE WHEN large AND complexity > 0.1 THEN 'complex' WHEN large THEN 'simple' ELSE 'no_caption' END WHEN k IN (0, 5) THEN 'technical' WHEN large THEN 'captioned' ELSE 'unclear' END AS reason FROM q)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    captions = F.array(F.lit("Wiring diagram"), F.lit("company LOGO"), F.lit(None), F.lit("abc"), F.lit("A nice picture"), F.lit("Site Map"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), id_.alias("idx"), (id_ * 37 % 400).cast("int").alias("width"), (id_ * 91 % 300).cast("int").alias("height"), F.concat(F.lit("h"), id_ % 3).alias("hash"), F.get(captions, (id_ % 6).cast("int")).alias("caption"), (id_ % 10 / 20.0).alias("complexity"))


@query(f"WITH {_JUDGED} SELECT doc_id, idx, reason, reason IN ('complex', 'technical', 'captioned') AS keep FROM r")
def image_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.image_rules(_images(spark, sf_dir)).select("doc_id", "idx", "reason", "keep")


@query(f"WITH {_JUDGED} SELECT count(*) AS processed, count(*) FILTER (reason IN ('complex', 'technical', 'captioned')) AS kept, count(*) FILTER (reason NOT IN ('complex', 'technical', 'captioned')) AS skipped, count(DISTINCT CASE WHEN reason NOT IN ('too_small', 'extreme_ratio') THEN doc_id || hash END) AS unique_images, round(count(*) FILTER (reason IN ('complex', 'technical', 'captioned')) / count(*)::DOUBLE, 6) AS keep_rate FROM r")
def image_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.image_stats(structure.image_rules(_images(spark, sf_dir)))


@query(f"""WITH {_EL}, e AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS p, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY idx) AS i FROM el), m AS (SELECT *, max(p) OVER (PARTITION BY doc_id) + 1 AS pages FROM e),
 x AS (SELECT doc_id, page_no, idx, text, 'first_page' AS part FROM m WHERE p = 0 AND length(text) > 20 UNION ALL SELECT doc_id, page_no, idx, text, 'headers' FROM m WHERE p < 10 AND header UNION ALL SELECT doc_id, page_no, idx, text, 'middle' FROM m WHERE pages > 3 AND p = pages // 2 AND i <= 5 AND length(text) > 30)
 SELECT doc_id, part, CAST(n AS INT) AS n, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY page_no, idx) AS n FROM x) WHERE n <= CASE part WHEN 'first_page' THEN 10 WHEN 'headers' THEN 20 ELSE 5 END""")
def summary_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.content_sample(_elements(spark, sf_dir))


@query("""WITH c AS (SELECT lang AS doc_id, source AS top, source || '_' || (doc_id % 5) AS section_id, CAST(floor(doc_id / 20) AS INT) AS p FROM documents), o AS (SELECT doc_id, top, count(*) AS n, min(p) AS a, max(p) AS b FROM c GROUP BY 1, 2), s AS (SELECT doc_id, count(DISTINCT section_id) AS sections FROM c GROUP BY 1),
 d AS (SELECT doc_id, max_by(top, (n, top)) AS dominant, round(max(n) / sum(n)::DOUBLE, 6) AS share, max(b) - min(a) AS page_spread FROM o GROUP BY 1) SELECT d.*, sections, share < 0.7 AND page_spread > 50 AND sections > 8 AS whole_system FROM d JOIN s USING (doc_id)""")
def system_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), F.col("source").alias("top"), F.concat_ws("_", "source", F.col("doc_id") % 5).alias("section_id"), F.floor(F.col("doc_id") / 20).cast("int").alias("page_number"))
    return structure.dominance(c)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at"), F.col("event_id").alias("seq"), (F.col("value").cast("long") % 40 + 1).alias("duration"), F.col("event_type").alias("text"))


_SEG = "sg AS (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS t, event_id AS seq, CAST(trunc(value) AS BIGINT) % 40 + 1 AS d, event_type AS text FROM events)"


@query("SELECT event_type AS key, event_id AS seq FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE n <= 100 OR i % greatest(n // 100, 1) = 0")
def sampled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.every_nth(table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq")))


@query(f"WITH {_SEG} SELECT key, 'video' AS title, 0::BIGINT AS start_s, max(t + d) AS end_s FROM sg GROUP BY key")
def fallback_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).select("key", (F.col("at") + F.col("duration")).alias("end_s"), F.lit("video").alias("title"))
    return structure.one_chapter(s)


@query(f"WITH {_SEG}, z AS (SELECT key, max(t + d) AS m FROM sg GROUP BY key) SELECT key, CAST(t // 3600 AS INT) AS page_no, t // 3600 * 3600 AS start_s, least((t // 3600 + 1) * 3600, any_value(m)) AS end_s, CAST(count(*) AS INT) AS n, string_agg(text, ' ' ORDER BY t, seq) AS text FROM sg JOIN z USING (key) GROUP BY key, t // 3600")
def video_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.video_pages(_segments(spark, sf_dir).withColumn("end_s", F.col("at") + F.col("duration")), 3600)


@query(f"""WITH RECURSIVE {_SEG}, e AS (SELECT key, t // 600 AS t, row_number() OVER (PARTITION BY key ORDER BY t // 600) AS r FROM sg WHERE text IN ('click', 'view')),
 f AS (SELECT key, r, t AS kept, TRUE AS yes FROM e WHERE r = 1 UNION ALL SELECT e.key, e.r, CASE WHEN e.t - f.kept > 5 THEN e.t ELSE f.kept END, e.t - f.kept > 5 FROM f JOIN e ON e.key = f.key AND e.r = f.r + 1) SELECT key, kept AS "at" FROM f WHERE yes""")
def screenshots_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).select("key", F.floor(F.col("at") / 600).alias("at"), "text")
    return structure.merged_shots(s.filter("text = 'click'"), s.filter("text = 'view'"))


@query(f"""WITH RECURSIVE {_SEG}, e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS r FROM sg),
 f AS (SELECT key, r, 0 AS chunk_no, t AS start_s, t + d AS end_s, d AS total, 1 AS n, text FROM e WHERE r = 1 UNION ALL
 SELECT e.key, e.r, CASE WHEN f.total + e.d <= 60 THEN f.chunk_no ELSE f.chunk_no + 1 END, CASE WHEN f.total + e.d <= 60 THEN f.start_s ELSE e.t END, e.t + e.d, CASE WHEN f.total + e.d <= 60 THEN f.total + e.d ELSE e.d END, CASE WHEN f.total + e.d <= 60 THEN f.n + 1 ELSE 1 END, CASE WHEN f.total + e.d <= 60 THEN f.text || ' ' || e.text ELSE e.text END FROM f JOIN e ON e.key = f.key AND e.r = f.r + 1)
 SELECT key, CAST(chunk_no AS INT) AS chunk_no, start_s, end_s, CAST(n AS INT) AS n, text, CAST(start_s // 60 AS INT) AS page_number, coalesce('Day ' || CASE WHEN start_s < 86400 * 20 THEN start_s // 86400 END, 'Untitled') AS chapter FROM f QUALIFY row_number() OVER (PARTITION BY key, chunk_no ORDER BY r DESC) = 1""")
def transcript_chunks_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.transcript_chunks(_segments(spark, sf_dir))
    chapters = spark.range(20).select(F.col("id").alias("idx"), (F.col("id") * 86400).alias("from_s"), ((F.col("id") + 1) * 86400).alias("to_s"))
    out = expand.first_interval(made, chapters, "start_s", "from_s", "to_s", "idx", 86400)
    return out.select("key", "chunk_no", "start_s", "end_s", "n", "text", F.floor(F.col("start_s") / 60).cast("int").alias("page_number"), F.coalesce(F.concat(F.lit("Day "), F.col("idx").cast("string")), F.lit("Untitled")).alias("chapter"))


@query(f'WITH RECURSIVE {_SEG}, e AS (SELECT key, t // 3600 AS t, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS r FROM sg), f AS (SELECT key, r, t AS kept, TRUE AS yes FROM e WHERE r = 1 UNION ALL SELECT e.key, e.r, CASE WHEN e.t - f.kept > 5 THEN e.t ELSE f.kept END, e.t - f.kept > 5 FROM f JOIN e ON e.key = f.key AND e.r = f.r + 1) SELECT key, kept AS "at" FROM f WHERE yes')
def dedupe_gap_5s(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).select("key", F.floor(F.col("at") / 3600).alias("at"))
    return folds.fold(s, "key", ["at"], folds.spaced(5), "key bigint, at bigint")


@query("SELECT label, n, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 12 ELSE 99 END AS INT) AS level FROM (SELECT k, CASE k WHEN 0 THEN 'Title' WHEN 1 THEN 'section-2-x' WHEN 2 THEN 'Heading' WHEN 3 THEN 'text' WHEN 4 THEN 'list-3' ELSE 'heading-12-4' END AS label, count(*) AS n FROM (SELECT event_id % 6 AS k FROM events) GROUP BY k)")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(_labels("event_id").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", ingest.heading_level(F.col("label")))


@query(r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>|<p(?:\s[^>]*)?>.*?</p>|<li(?:\s[^>]*)?>.*?</li>')) AS e FROM pages), n AS (SELECT page_id, regexp_extract(e, '^<(h[1-6]|p|li)', 1) AS tag, trim(regexp_replace(regexp_replace(e, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM e)
 SELECT page_id AS doc_id, CASE tag WHEN 'p' THEN 'text' WHEN 'li' THEN 'list_item' ELSE 'section-' || substring(tag, 2, 1) || '-header' END AS label, text, count(*) AS n FROM n GROUP BY 1, 2, 3""")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = pipeline.html_items(table(spark, sf_dir, "pages"))
    return items.groupBy("doc_id", "label", "text").agg(F.count(F.lit(1)).alias("n"))


@query()
def hierarchy_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phase over all documents; each phase has its own query and SQL, the whole is tested on
    literal documents."""
    made = pipeline.hierarchy(_elements(spark, sf_dir))
    sections = made["sections"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))
    chunks = made["chunks"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("characters"))
    pages = made["page_index"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    return chunks.join(sections, "doc_id", "left").join(pages, "doc_id", "left").fillna(0)


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), l AS (SELECT doc_id, t, unnest(range(1, 8)) AS level FROM w)
 SELECT doc_id, array_to_string(list_transform(range(1, level), lambda k: '0000.'), '') || '0000.' AS place, coalesce(t[level], '') AS title, level::INT AS level, (level * 3)::INT AS page FROM l
 UNION ALL SELECT doc_id, array_to_string(list_transform(range(1, level), lambda k: '0000.'), '') || '0001.', coalesce(t[level + 7], ''), level::INT, 1 FROM l""")
def outline_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with an outline of seven levels, two entries each."""
    words = F.split("text", " ")
    word = lambda k: F.coalesce(F.get(words, F.lit(k - 1)), F.lit(""))
    below = None
    for level in range(7, 0, -1):
        own = [word(level).alias("title"), F.lit(level * 3).alias("page")] + ([below.alias("children")] if below is not None else [])
        other = [word(level + 7).alias("title"), F.lit(None).cast("int").alias("page")] + ([F.lit(None).alias("children")] if below is not None else [])
        below = F.array(F.struct(*own), F.struct(*other))
    return recursion.outline(table(spark, sf_dir, "documents").select("doc_id", F.to_json(below).alias("outline")))


_TREE = "tree AS (SELECT 'all' AS doc_id, doc_id + 1 AS idx, source || '-' || doc_id AS title, CASE WHEN doc_id > 0 THEN (doc_id + 1) // 2 END AS parent_idx FROM documents)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a binary tree: as deep as the logarithm of their number."""
    id_ = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.lit("all").alias("doc_id"), (id_ + 1).alias("idx"), F.concat_ws("-", "source", id_).alias("title"), F.when(id_ > 0, F.floor((id_ + 1) / 2)).alias("parent_idx")
    )


@query(f"WITH RECURSIVE {_TREE}, d AS (SELECT doc_id, idx, 1 AS level, title AS path FROM tree WHERE parent_idx IS NULL UNION ALL SELECT s.doc_id, s.idx, d.level + 1, d.path || ' > ' || s.title FROM d JOIN tree s ON s.doc_id = d.doc_id AND s.parent_idx = d.idx) SELECT doc_id, idx, level, path FROM d")
def section_path_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root-to-leaf titles of a tree that no fixed number of joins would do for."""
    return recursion.paths(_tree(spark, sf_dir))


@query(f"WITH RECURSIVE {_TREE}, u AS (SELECT doc_id, idx, parent_idx AS ancestor, 1 AS distance FROM tree WHERE parent_idx IS NOT NULL UNION ALL SELECT u.doc_id, u.idx, s.parent_idx, u.distance + 1 FROM u JOIN tree s ON s.doc_id = u.doc_id AND s.idx = u.ancestor WHERE s.parent_idx IS NOT NULL) SELECT doc_id, idx, ancestor, distance FROM u")
def section_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursion.ancestors(_tree(spark, sf_dir))
