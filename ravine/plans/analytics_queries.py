"""Operational analytics over events, orders and conversations, and data modification."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.operators import analytics, expand, ingest
from ravine.functions import text
from ravine.plans.registry import query
from ravine.plans.sql import CHUNKS
from ravine.sources import tables
from ravine.sources.shared import scratch
from ravine.sources.tables import table
from ravine.streaming import streams

_JOBS = "jobs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status, o_orderdate AS queued_at, o_totalprice AS cost, o_orderpriority AS priority FROM orders)"
_QUERIES = "q AS (SELECT event_id AS id, event_type AS query_type, event_type <> 'error' AS success, value AS cost, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, user_id, ts AS created_at, props AS metrics FROM events)"


def _at(sql: str) -> str:
    """``at`` is a word of the SQL dialect; as a column it stands in quotes."""
    return re.sub(r"\bat\b", '"at"', sql)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("queued_at"), F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("priority"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("query_type"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), "user_id", F.col("ts").alias("created_at"), F.col("props").alias("metrics"))


@query(f"WITH {_JOBS} SELECT count(*) AS total, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, round(avg(cost), 9) AS avg_cost, round(sum(cost), 2) AS total_cost FROM jobs")
def job_queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.queue_stats(jobs(spark, sf_dir))


@query("""WITH j AS (SELECT CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status, user_id % 90 + value / 1000 AS took, event_type NOT IN ('view', 'click') AS ended, value FROM events)
 SELECT count(*) AS total_jobs, count(*) FILTER (status = 'queued') AS queued_jobs, count(*) FILTER (status = 'processing') AS processing_jobs, count(*) FILTER (status = 'completed') AS completed_jobs, count(*) FILTER (status = 'failed') AS failed_jobs, count(*) FILTER (status = 'cancelled') AS cancelled_jobs,
 round(avg(CASE WHEN ended THEN CAST(round(floor(took * 1000000) / 1e6) AS INT) END), 6) AS avg_duration_seconds, round(sum(value), 2) AS total_cost FROM j""")
def job_queue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five states of a queue; a job's duration is that between its times."""
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp")
    status = F.when(kind == "view", "queued").when(kind == "click", "processing").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("cancelled")
    ended = F.timestamp_micros(F.unix_micros(ts) + F.floor((F.col("user_id") % 90 + F.col("value") / 1000) * 1000000))
    return analytics.queue_states(table(spark, sf_dir, "events").select(status.alias("status"), ts.alias("started_at"), F.when(~kind.isin("view", "click"), ended).alias("completed_at"), F.col("value").alias("cost")))


@query(f"WITH {_JOBS} SELECT * FROM jobs WHERE status = 'processing' ORDER BY queued_at, id LIMIT 10")
def active_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.active_workers(jobs(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT * FROM jobs WHERE status = 'queued' ORDER BY priority, queued_at, id LIMIT 20")
def queue_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.next_jobs(jobs(spark, sf_dir))


_DAILY = "SELECT CAST(created_at AS DATE) AS day, query_type, count(*) AS queries, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, round(avg(cost), 9) AS avg_cost, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures FROM q {} GROUP BY 1, 2"


@query(f"WITH {_QUERIES} " + _DAILY.format(""))
def daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily_costs(queries(spark, sf_dir))


@query(f"WITH {_QUERIES} " + _DAILY.format("WHERE created_at >= TIMESTAMP '2024-01-24'"))
def daily_cost_last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily_costs(queries(spark, sf_dir), datetime.datetime(2024, 1, 24))


@query(f"WITH {_QUERIES} SELECT query_type, count(*) AS queries, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost FROM q GROUP BY ROLLUP (query_type)")
def cost_by_type_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.cost_by_type(queries(spark, sf_dir))


@query(f"WITH {_QUERIES} SELECT count(*) AS queries, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 2) AS cost, round(avg(cost), 9) AS avg_cost, count(DISTINCT user_id) AS users, max(created_at) AS last_query FROM q")
def analytics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.summary(queries(spark, sf_dir))


@query("WITH c AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS hits, ts AS created_at FROM events) SELECT count(*) AS entries, CAST(sum(hits) AS BIGINT) AS hits, round(avg(hits), 9) AS avg_hits, max(hits) AS max_hits, count(*) FILTER (created_at > TIMESTAMP '2024-01-29') AS recent, round(sum(hits) / greatest(count(*), 1)::DOUBLE, 9) AS hit_rate FROM c WHERE created_at > TIMESTAMP '2024-01-23'")
def query_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.cache_stats(queries(spark, sf_dir).withColumnRenamed("tokens", "hits"), datetime.datetime(2024, 1, 30))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS queries, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 9) AS avg_score, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS DOUBLE) < 30) AS low FROM events WHERE ts > TIMESTAMP '2024-01-05' GROUP BY 1")
def daily_retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily_retrieval(queries(spark, sf_dir), datetime.datetime(2024, 1, 5))


@query("WITH m AS (SELECT unnest([event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS category, value FROM events) SELECT category, count(*) AS queries, round(avg(value), 9) AS avg_value FROM m GROUP BY 1")
def category_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.array("event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")).alias("categories"), "value")
    return analytics.category_performance(m)


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS coverage, ts AS created_at FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 < 0.6 ORDER BY ts DESC, id LIMIT 20")
def low_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.low_coverage(queries(spark, sf_dir))


@query("SELECT label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS percent FROM embeddings GROUP BY label")
def topic_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.distribution(table(spark, sf_dir, "embeddings"), "label")


@query("WITH u AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'text-embedding-3-small' ELSE 'unknown' END AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS p, CAST(json_extract_string(props, '$.k') AS BIGINT) AS c FROM events) SELECT model, count(*) AS n, round(sum(round(p * CASE model WHEN 'gpt-4o' THEN 2.5e-6 WHEN 'gpt-4o-mini' THEN 0.15e-6 WHEN 'text-embedding-3-small' THEN 0.02e-6 ELSE 0 END + c * CASE model WHEN 'gpt-4o' THEN 10e-6 WHEN 'gpt-4o-mini' THEN 0.6e-6 ELSE 0 END, 8)), 6) AS cost FROM u GROUP BY 1")
def model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("event_id") % 4 == 0, "gpt-4o").when(F.col("event_id") % 4 == 1, "gpt-4o-mini").when(F.col("event_id") % 4 == 2, "text-embedding-3-small").otherwise("unknown")
    k = F.get_json_object("props", "$.k").cast("long")
    used = analytics.model_cost(table(spark, sf_dir, "events").select(model.alias("model"), (k * 100).alias("prompt_tokens"), k.alias("completion_tokens")))
    return used.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("SELECT user_id, max(epoch_us(ts)) - min(epoch_us(ts)) AS span_us, CAST(round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6) AS INT) AS seconds FROM events GROUP BY 1")
def job_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    both = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return both.select("user_id", (F.unix_micros("b") - F.unix_micros("a")).alias("span_us"), analytics.job_seconds(F.col("a"), F.col("b")).alias("seconds"))


@query("SELECT user_id AS job_id, max_by(event_type, (ts, event_id)) AS state, count(*) FILTER (event_type = 'retry') AS retries, max(ts) AS updated_at FROM events GROUP BY 1")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.job_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("state")))


@query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY text) AS copies FROM documents) SELECT doc_id AS id, sha256(text) AS file_hash, copies FROM d WHERE n = 1")
def dedup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("file_hash"))
    return d.groupBy("file_hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "file_hash", "copies")


@query("SELECT o_custkey AS id, o_orderkey AS version, o_orderdate AS created_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at"))
    return tables.latest(o, "id", F.col("version").desc())


@query("SELECT 'parents' AS name, count(*) AS deleted FROM documents WHERE source = 'src3' UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = 'src3') UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def cascade_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    children = {"embeddings": (table(spark, sf_dir, "embeddings"), "vec_id"), "labels": (table(spark, sf_dir, "labels"), "doc_id")}
    return tables.cascade_delete(d, children, d.filter("source = 'src3'"), "doc_id")[2]


@query(f"WITH {_JOBS}, n AS (SELECT event_id AS id, event_type AS status, value AS cost FROM events WHERE event_id % 3 = 0) SELECT coalesce(j.id, n.id) AS id, coalesce(n.status, j.status) AS status, coalesce(j.cost, n.cost) AS cost FROM jobs j FULL JOIN n ON j.id = n.id")
def status_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "events").filter("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("value").alias("cost"))
    return tables.upsert(jobs(spark, sf_dir).select("id", "status", "cost"), new, "id", keep=("cost",))


@query("WITH o AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id AS id FROM documents) SELECT id, 'old' AS origin FROM o UNION ALL SELECT id, 'new' FROM n WHERE id NOT IN (SELECT id FROM o)")
def append_ignore_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return tables.append_new(d.filter("id % 2 = 0").withColumn("origin", F.lit("old")), d.withColumn("origin", F.lit("new")), "id")


@query(_at("WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS at, event_type FROM events) SELECT event_id, user_id, event_type, CAST(CAST(floor(at / 60.0) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(at % 60 AS VARCHAR), 2, '0') AS stamp FROM e"))
def transcript_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", text.minutes_seconds(at).alias("stamp"))


def _segments(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200).alias("at"), F.col("event_id").alias("seq"))


_CHAPTERS = "ch AS (SELECT range AS idx, range * 86400 * 3 AS start_s, range * 86400 * 3 + 86400 * 4 AS end_s FROM range(8))"


@query(_at(f"WITH {_CHAPTERS}, e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS at FROM events) SELECT event_id, at, idx, start_s, end_s FROM e LEFT JOIN ch ON at >= start_s AND at < end_s QUALIFY row_number() OVER (PARTITION BY event_id, at ORDER BY idx) = 1"))
def chapter_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = spark.range(8).select(F.col("id").alias("idx"), (F.col("id") * 86400 * 3).alias("start_s"), (F.col("id") * 86400 * 3 + 86400 * 4).alias("end_s"))
    points = _segments(spark, sf_dir).select(F.col("seq").alias("event_id"), "at")
    return expand.first_interval(points, chapters, "at", "start_s", "end_s", "idx", 86400)


@query(_at("WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS at, event_type FROM events), c AS (SELECT event_id AS chunk, user_id, at AS a, at + 7200 AS z FROM e WHERE event_type = 'view'), s AS (SELECT event_id, user_id, at FROM e WHERE event_type = 'click') SELECT s.event_id, s.user_id, s.at, chunk, a, z FROM s LEFT JOIN c ON s.user_id = c.user_id AND at >= a AND at <= z QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY chunk) = 1"))
def screenshot_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200).alias("at"), "event_type")
    chunks = e.filter("event_type = 'view'").select(F.col("event_id").alias("chunk"), "user_id", F.col("at").alias("a"), (F.col("at") + 7200).alias("z"))
    return expand.first_interval(e.filter("event_type = 'click'").select("event_id", "user_id", "at"), chunks, "at", "a", "z", "chunk", 7200, by="user_id", closed=True)


def _stream(spark, sf_dir, name, make, mode="complete", files=8):
    at = scratch(spark, f"stream-{name}")
    return streams.to_table(make(streams.read_events(spark, f"{sf_dir}/events.parquet", files)), f"{at}/checkpoint", f"{at}/table", mode)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "daily", streams.daily_cost).select(F.to_date("window.start").alias("day"), "event_type", "n", "value")


@query("SELECT DISTINCT event_id, ts, event_type FROM events")
def stream_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "feed", lambda e: streams.changes(e).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type"), "append").drop("batch")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "sessions", streams.sessions).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


@query("SELECT user_id, to_timestamp(floor(epoch(ts) / 60) * 60)::TIMESTAMP AS page_start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "pages", streams.pages).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("page_start"), "n")


@query("SELECT event_id AS id, ' ' || event_type || ' ' AS fts FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE event_type END AS event_type FROM events)")
def stream_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "fts", lambda e: streams.words(e, "event_type"), "append").select(F.col("event_id").alias("id"), "fts")


@query("SELECT DISTINCT event_id AS job_id, event_type AS status, ts FROM events")
def stream_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stream(spark, sf_dir, "visible", lambda e: streams.visible(e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), "ts")), "append")
    return out.select("job_id", "status", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with one checkpoint: the second finds all done and adds nothing."""
    at, path = scratch(spark, "stream-resume"), f"{sf_dir}/events.parquet"
    for _ in range(2):
        out = streams.to_table(streams.read_events(spark, path, 1).select("event_id", "event_type"), f"{at}/checkpoint", f"{at}/table", "append")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 ELSE 1 END, ts, event_id) AS place FROM events")
def stream_priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A micro-batch drained by priority, then time: every row's place in what was written."""
    at = scratch(spark, "stream-queue")
    jobs = streams.read_events(spark, f"{sf_dir}/events.parquet", 1 << 30).select("event_id", "ts", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("priority"))
    streams.run(jobs, f"{at}/checkpoint", f"{at}/table", order=["priority", "ts", "event_id"])
    return streams.places(spark, f"{at}/table", jobs.schema.add("batch", "long")).select(F.col("event_id").alias("id"), "place")


_METRICS = "mt AS (SELECT event_id, ts AS created_at, 'doc' || user_id % 3 AS doc_id, value / 500 AS s, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS c, [event_type, 'all'] AS categories FROM events)"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    m = F.to_json(F.struct((F.col("value") / 500).alias("avg_score"), (k / 100).alias("topic_coverage"), F.lit(2).alias("topic_diversity"), F.lit(0.25).alias("score_variance")))
    return e.select(F.col("ts").alias("created_at"), F.concat(F.lit("doc"), F.col("user_id") % 3).alias("doc_id"), m.alias("metrics"), F.array("event_type", F.lit("all")).alias("categories"))


_LIVE = "WHERE created_at > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND doc_id = 'doc1'"


@query(f"WITH {_METRICS} SELECT count(*) AS total_queries, round(avg(s), 9) AS avg_retrieval_score, round(avg(c), 9) AS avg_topic_coverage, 2.0::DOUBLE AS avg_topic_diversity, 0.25::DOUBLE AS avg_score_variance FROM mt {_LIVE}")
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.retrieval_stats(_metrics(spark, sf_dir), datetime.datetime(2024, 1, 30), doc_id="doc1")[0]


@query(f"WITH {_METRICS} SELECT category, count(*) AS queries, round(avg(c), 9) AS avg_coverage FROM (SELECT unnest(categories) AS category, c FROM mt {_LIVE}) GROUP BY 1")
def retrieval_stats_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.retrieval_stats(_metrics(spark, sf_dir), datetime.datetime(2024, 1, 30), doc_id="doc1")[1]


@query("WITH c AS (SELECT d.doc_id, e.label FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id) SELECT count(*) AS total, count(label) AS with_topic, count(label) AS with_topics FROM c")
def topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.topic_counts(tables.chunks(spark, sf_dir))[1]


@query(f"WITH {CHUNKS} SELECT topic, array_to_string(topics, ',') AS topics, count(*) AS n FROM chunks WHERE topic IS NOT NULL GROUP BY 1, 2")
def topic_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.topic_counts(tables.chunks(spark, sf_dir))[0].withColumn("topics", F.array_join("topics", ","))


@query("""WITH r AS (SELECT event_id % 5 <> 0 AS cat, event_id % 3 = 0 AS com, event_id % 2 = 0 AS top, event_id % 7 = 0 AS hit, event_id % 11 / 10.0::DOUBLE AS cov, value / 500 AS s FROM events)
 SELECT count(*) AS total, round(count(*) FILTER (cat) / count(*)::DOUBLE, 6) AS category_accuracy, round(count(*) FILTER (com) / count(*)::DOUBLE, 6) AS complexity_accuracy, round(count(*) FILTER (top) / count(*)::DOUBLE, 6) AS top_k_accuracy, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS cache_hit_rate, round(avg(cov), 6) AS coverage,
 round(sum(s) FILTER (NOT hit) / greatest(1, count(*) FILTER (NOT hit)), 6) AS mean_top_score, round(sum(s / 2) FILTER (NOT hit) / greatest(1, count(*) FILTER (NOT hit)), 6) AS mean_avg_score, round(avg(cov), 6) >= 0.7 AND round(count(*) FILTER (cat) / count(*)::DOUBLE, 6) >= 0.8 AS passed FROM r""")
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, s = F.col("event_id"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 500)
    r = table(spark, sf_dir, "events").select((id_ % 5 != 0).alias("category_match"), (id_ % 3 == 0).alias("complexity_match"), (id_ % 2 == 0).alias("top_k_match"), (id_ % 7 == 0).alias("cache_hit"), (id_ % 11 / 10.0).alias("coverage"), s.alias("top_score"), (s / 2).alias("avg_score"))
    return analytics.accuracy(r)


@query("SELECT event_id, round((event_id % 900 + event_id % 70 + event_id % 33 * 10) * 1.5e-7::DOUBLE, 9) AS document_cost, round(event_id % 7000 / 60.0::DOUBLE * 0.006::DOUBLE + event_id % 33 * 100 * 2e-8::DOUBLE + (event_id % 900 + 1000) * 1.5e-7::DOUBLE, 9) AS video_cost FROM events")
def ingestion_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", analytics.document_cost(id_ % 900, id_ % 70, id_ % 33).alias("document_cost"), analytics.video_cost(id_ % 7000, id_ % 33, id_ % 900).alias("video_cost"))
