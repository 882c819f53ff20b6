"""Keyed state over several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.plans.answer_queries import _ACTION, _OK
from ravine.plans.registry import query
from ravine.plans.structure_queries import _SEG, _segments
from ravine.sources.shared import scratch
from ravine.sources.tables import table
from ravine.streaming import keyed, streams

#: Batches of the change feed, six days of polling each.
POLLS, DAYS = 6, 6
START_MS = 1704067200000
#: Batches of the other streams.
PARTS = 5


def _fifth(df: DataFrame, column: str):
    """Which fifth of the column's range a row is in."""
    top = df.agg(F.max(column)).first()[0] or 0
    return F.least(F.lit(PARTS - 1), F.floor(F.col(column) / ((top + PARTS) // PARTS))).cast("int")


_STATUS = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"


@query(f"""WITH u AS (SELECT user_id AS job_id, event_id, {_STATUS} AS status, epoch_us(ts) // 1000 AS updated_ms, epoch_us(ts) // 1000 + event_id % 8 * 60000 AS polled_ms FROM events
 UNION ALL SELECT user_id, event_id, {_STATUS}, epoch_us(ts) // 1000, epoch_us(ts) // 1000 + 3 * 86400000 FROM events WHERE event_id % 5 = 0),
 s AS (SELECT * FROM u WHERE status IN ('queued', 'processing') OR updated_ms > polled_ms - 5 * 60000)
 SELECT * FROM s QUALIFY updated_ms IS DISTINCT FROM lag(updated_ms) OVER (PARTITION BY job_id ORDER BY polled_ms, event_id)""")
def stream_job_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates polled up to seven minutes late, a fifth of them again three days later, in six batches."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.expr(_STATUS).alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("updated_ms"))
    late = e.withColumn("polled_ms", F.col("updated_ms") + F.col("event_id") % 8 * 60000)
    again = e.filter("event_id % 5 = 0").withColumn("polled_ms", F.col("updated_ms") + 3 * 86400000)
    rows = late.unionByName(again).withColumn("poll", F.least(F.lit(POLLS - 1), F.floor((F.col("polled_ms") - START_MS) / (DAYS * 86400000))).cast("int"))
    n = keyed.pages(rows)
    return keyed.in_batches(rows, "poll", POLLS, lambda u: keyed.feed(u, n), scratch(spark, "stream-feed")).drop("batch")


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id, {_ACTION} AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
 f AS (SELECT job_id, 0 AS r, 0::BIGINT AS event_id, '' AS action, FALSE AS accepted, 'queued' AS status, 0 AS retries FROM (SELECT DISTINCT job_id FROM e) UNION ALL
 SELECT e.job_id, e.r, e.event_id, e.action, {_OK}, CASE WHEN {_OK} THEN CASE e.action WHEN 'start' THEN 'processing' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled' ELSE 'queued' END ELSE f.status END, f.retries + CASE WHEN ({_OK}) AND e.action = 'retry' THEN 1 ELSE 0 END FROM f JOIN e ON e.job_id = f.job_id AND e.r = f.r + 1)
 SELECT job_id, event_id, action, accepted, status, CAST(retries AS INT) AS retries FROM f WHERE r > 0""")
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's job from its actions; a job's state passes from batch to batch."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("at"), "event_id", F.expr(_ACTION).alias("action"), _fifth(e, "event_id").alias("part"))
    n = keyed.pages(rows)
    return keyed.in_batches(rows, "part", PARTS, lambda a: keyed.transitions(a, n), scratch(spark, "stream-states")).drop("at", "batch")


@query(f'WITH RECURSIVE {_SEG}, e AS (SELECT key, t // 3600 AS t, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS r FROM sg), f AS (SELECT key, r, t AS kept, TRUE AS yes FROM e WHERE r = 1 UNION ALL SELECT e.key, e.r, CASE WHEN e.t - f.kept > 5 THEN e.t ELSE f.kept END, e.t - f.kept > 5 FROM f JOIN e ON e.key = f.key AND e.r = f.r + 1) SELECT key, kept AS "at" FROM f WHERE yes')
def stream_dedupe_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times more than five hours after the last one kept, over batches that cut a key's times."""
    s = _segments(spark, sf_dir).select("key", F.floor(F.col("at") / 3600).alias("at"))
    n = keyed.pages(s)
    return keyed.in_batches(s.withColumn("part", _fifth(s, "at")), "part", PARTS, lambda t: keyed.spaced(t, 5, n), scratch(spark, "stream-gap")).drop("batch")


@query(f"""WITH e AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS priority, least(4, event_id // (((SELECT max(event_id) FROM events) + 5) // 5)) AS batch FROM events)
 SELECT event_id, batch::BIGINT AS batch, row_number() OVER (PARTITION BY batch ORDER BY priority, ts, event_id) AS place FROM e""")
def stream_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch of a queue drained by priority, then time: the place in which each row was written."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", "ts", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("priority"), _fifth(e, "event_id").alias("part"))
    at = scratch(spark, "stream-drained")
    out = keyed.in_batches(rows, "part", PARTS, lambda q: q, at, order=["priority", "ts", "event_id"])
    return streams.places(spark, f"{at}/table", out.schema).select("event_id", "batch", "place")
