"""Operational analytics: queue, cost, cache, retrieval quality, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.operators.search import where

#: US dollars per token (prompt or input, completion).
PRICES = {"gpt-4o": (2.50e-6, 10.00e-6), "gpt-4o-mini": (0.150e-6, 0.600e-6), "text-embedding-3-small": (0.020e-6, 0.0), "text-embedding-3-large": (0.130e-6, 0.0), "text-embedding-ada-002": (0.100e-6, 0.0)}
#: US dollars per ingested token and per transcribed minute.
INGEST_TOKEN, WHISPER_MINUTE = 1.5e-7, 0.006


def queue_stats(jobs: DataFrame) -> DataFrame:
    """One row: jobs by status, mean priority length and total cost."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return jobs.agg(F.count(F.lit(1)).alias("total"), count("queued"), count("processing"), count("completed"), F.round(F.avg("cost"), 9).alias("avg_cost"), F.round(F.sum("cost"), 2).alias("total_cost"))


def queue_states(jobs: DataFrame) -> DataFrame:
    """One row: jobs in each of the five states, the mean duration of ended ones in whole seconds a job,
    and the total cost. jobs: status, started_at, completed_at, cost."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_jobs")
    seconds = F.when(F.col("completed_at").isNotNull(), job_seconds(F.coalesce("started_at", "completed_at"), F.col("completed_at")))
    states = map(count, ["queued", "processing", "completed", "failed", "cancelled"])
    return jobs.agg(F.count(F.lit(1)).alias("total_jobs"), *states, F.round(F.avg(seconds), 6).alias("avg_duration_seconds"), F.round(F.sum("cost"), 2).alias("total_cost"))


def active_workers(jobs: DataFrame, k: int = 10) -> DataFrame:
    return jobs.filter("status = 'processing'").orderBy("queued_at", "id").limit(k)


def next_jobs(jobs: DataFrame, k: int = 20) -> DataFrame:
    """Queued jobs, the highest priority first, then the oldest."""
    return jobs.filter("status = 'queued'").orderBy("priority", "queued_at", "id").limit(k)


def job_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two times, rounded."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6).cast("int")


def daily_costs(queries: DataFrame, since=None) -> DataFrame:
    """By day and type: queries, tokens, cost, mean time, successes and failures."""
    df = queries if since is None else queries.filter(F.col("created_at") >= F.lit(since))
    return df.groupBy(F.to_date("created_at").alias("day"), "query_type").agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("cost"), 4).alias("cost"),
        F.round(F.avg("cost"), 9).alias("avg_cost"),
        F.count_if("success").alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
    )


def cost_by_type(queries: DataFrame) -> DataFrame:
    """Each type and a grand total (type null) in one rollup."""
    return queries.rollup("query_type").agg(F.count(F.lit(1)).alias("queries"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def summary(queries: DataFrame) -> DataFrame:
    return queries.agg(F.count(F.lit(1)).alias("queries"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 2).alias("cost"), F.round(F.avg("cost"), 9).alias("avg_cost"), F.countDistinct("user_id").alias("users"), F.max("created_at").alias("last_query"))


def cache_stats(cache: DataFrame, as_of, days: int = 7) -> DataFrame:
    live = cache.filter(F.col("created_at") > F.lit(as_of) - F.expr(f"interval {days} days"))
    recent = F.col("created_at") > F.lit(as_of) - F.expr("interval 24 hours")
    out = live.agg(F.count(F.lit(1)).alias("entries"), F.sum("hits").alias("hits"), F.round(F.avg("hits"), 9).alias("avg_hits"), F.max("hits").alias("max_hits"), F.count_if(recent).alias("recent"))
    return out.withColumn("hit_rate", F.round(F.col("hits") / F.greatest("entries", F.lit(1)), 9))


def daily_retrieval(metrics: DataFrame, since=None) -> DataFrame:
    """By day, from the JSON metrics: queries and mean score and coverage."""
    df = metrics if since is None else metrics.filter(F.col("created_at") > F.lit(since))
    return df.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.get_json_object("metrics", "$.k").cast("double")), 9).alias("avg_score"), F.count_if(F.get_json_object("metrics", "$.k").cast("double") < 30).alias("low"))


def category_performance(metrics: DataFrame) -> DataFrame:
    """Unnest the categories, then group."""
    return metrics.select(F.explode("categories").alias("category"), "value").groupBy("category").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("value"), 9).alias("avg_value"))


def low_coverage(metrics: DataFrame, below: float = 0.6, k: int = 20) -> DataFrame:
    cover = F.get_json_object("metrics", "$.k").cast("double") / 100
    return metrics.withColumn("coverage", cover).filter(F.col("coverage") < below).orderBy(F.col("created_at").desc(), "id").limit(k).select("id", "coverage", "created_at")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts and percent of the total: a window over the aggregate."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def model_cost(usage: DataFrame) -> DataFrame:
    """Tokens times the model's prices; an unknown model costs nothing."""
    price = lambda i: F.coalesce(F.element_at(F.create_map(*(x for m, p in PRICES.items() for x in (F.lit(m), F.lit(p[i])))), F.col("model")), F.lit(0.0))
    return usage.withColumn("cost", F.round(F.col("prompt_tokens") * price(0) + F.col("completion_tokens") * price(1), 8))


def retrieval_metrics(results: DataFrame, expected: list[str], by: str = "query_id") -> DataFrame:
    """Per query: count, mean, max and min score; of the top 5 the population variance, the share
    that has an expected topic, and how many different topics there are.

    ``results``: query id, rank, score, topic, topics.
    """
    five = F.col("rank") <= 5
    topics = F.when(five, F.array_compact(F.array_union(F.array("topic"), F.coalesce("topics", F.array().cast("array<string>")))))
    hit = F.arrays_overlap(F.coalesce(topics, F.array().cast("array<string>")), F.array(*map(F.lit, expected))) if expected else F.lit(True)
    covered = F.count_if(five & hit) / F.least(F.lit(5), F.count(F.lit(1)))
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("score"), 6).alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.round(F.var_pop(F.when(five, F.col("score"))), 6).alias("variance"),
        F.round(covered, 6).alias("coverage"),
        F.size(F.array_distinct(F.flatten(F.collect_list(topics)))).alias("diversity"),
        F.transform(F.array_sort(F.collect_list(F.when(five, F.struct("rank", "score")))), lambda x: x["score"]).alias("top_scores"),
    )


def contamination(results: DataFrame, topic: str, n: int = 5) -> DataFrame:
    """The share of the first n results that carry a topic."""
    carried = (F.col("topic") == topic) | F.array_contains("topics", topic)
    return results.filter(F.col("rank") <= n).agg(F.round(F.avg(F.coalesce(carried, F.lit(False)).cast("double")), 6).alias("contamination"))


def conversation_stats(messages: DataFrame) -> DataFrame:
    """Per conversation: messages by role, mean length without its fraction, all characters."""
    size = F.length("content")
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"), F.floor(F.avg(size)).cast("long").alias("avg_length"), F.sum(size).cast("long").alias("characters"))


def job_states(events: DataFrame) -> DataFrame:
    """The latest state of each job, and its retries, from its events (job_id, at, state)."""
    return events.groupBy("job_id").agg(F.max_by("state", F.struct("at", "event_id")).alias("state"), F.count_if(F.col("state") == "retry").alias("retries"), F.max("at").alias("updated_at"))


def retrieval_stats(metrics: DataFrame, as_of, days: int = 7, **equal) -> tuple[DataFrame, DataFrame]:
    """Over the last days, with optional filters: queries and mean metrics, and the same by category.

    metrics: created_at, metrics (JSON with avg_score, topic_coverage, topic_diversity,
    score_variance), categories. A document is parsed once; what isn't JSON, or no number, counts for
    no mean.
    """
    live = metrics.filter((F.col("created_at") > F.lit(as_of) - F.expr(f"interval {days} days")) & where(**equal)).withColumn("__m", F.try_parse_json("metrics"))
    mean = lambda k: F.round(F.coalesce(F.avg(F.try_variant_get("__m", f"$.{k}", "double")), F.lit(0.0)), 9)
    names = {"avg_score": "avg_retrieval_score", "topic_coverage": "avg_topic_coverage", "topic_diversity": "avg_topic_diversity", "score_variance": "avg_score_variance"}
    total = live.agg(F.count(F.lit(1)).alias("total_queries"), *(mean(k).alias(v) for k, v in names.items()))
    each = live.withColumn("category", F.explode("categories")).groupBy("category").agg(F.count(F.lit(1)).alias("queries"), mean("topic_coverage").alias("avg_coverage"))
    return total, each


def topic_counts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks for each combination of topics, and how many have any."""
    tagged = F.col("topic").isNotNull() | (F.size("topics") > 0)
    each = chunks.filter(tagged).groupBy("topic", "topics").agg(F.count(F.lit(1)).alias("n"))
    total = chunks.agg(F.count(F.lit(1)).alias("total"), F.count("topic").alias("with_topic"), F.count_if(F.size("topics") > 0).alias("with_topics"))
    return each, total


def accuracy(results: DataFrame) -> DataFrame:
    """Shares of a run's results that match, mean coverage and scores (of what no cache answered), and
    whether coverage and categories reach their targets.

    results: category_match, complexity_match, top_k_match, cache_hit, coverage, top_score, avg_score.
    """
    n = F.count(F.lit(1))
    share = lambda c: F.round(F.count_if(F.col(c)) / n, 6).alias(c.replace("match", "accuracy"))
    asked = F.greatest(F.lit(1), F.count_if(~F.col("cache_hit")))
    mean = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)) / asked, 6).alias(f"mean_{c}")
    out = results.agg(n.alias("total"), share("category_match"), share("complexity_match"), share("top_k_match"), F.round(F.count_if("cache_hit") / n, 6).alias("cache_hit_rate"), F.round(F.avg("coverage"), 6).alias("coverage"), mean("top_score"), mean("avg_score"))
    return out.withColumn("passed", (F.col("coverage") >= 0.7) & (F.col("category_accuracy") >= 0.8))


#: Tokens that an embedded chunk and a chapter search are taken to have, of a document
#: and of a video, and US dollars per token of embeddings and of the small model.
CHUNK_TOKENS, VIDEO_CHUNK_TOKENS, CHAPTER_TOKENS, EMBED_TOKEN, SMALL_TOKEN = 10, 100, 1000, 2e-8, 1.5e-7


def document_cost(summary_tokens: Column, image_tokens: Column, chunks: Column) -> Column:
    return F.round((summary_tokens + image_tokens + chunks * CHUNK_TOKENS) * INGEST_TOKEN, 9)


def video_cost(seconds: Column, chunks: Column, summary_tokens: Column) -> Column:
    """Transcription by the minute, embeddings, summary and chapters."""
    return F.round(seconds / 60 * WHISPER_MINUTE + chunks * VIDEO_CHUNK_TOKENS * EMBED_TOKEN + (summary_tokens + CHAPTER_TOKENS) * SMALL_TOKEN, 9)
