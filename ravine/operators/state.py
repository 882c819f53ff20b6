"""Data that changes: job states from events, cache entries, catalogs, derived columns.

Tables are snapshots: every change takes a table and gives the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ravine.functions import grammar
from ravine.operators import folds

#: From which states an action is allowed, the state it leads to, and retries at most.
ACTIONS = {
    "start": (("queued",), "processing"),
    "complete": (("processing",), "completed"),
    "fail": (("processing",), "failed"),
    "cancel": (("queued", "processing"), "cancelled"),
    "retry": (("failed",), "queued"),
    "resume": (("failed", "cancelled"), "queued"),
}
MAX_RETRIES = 3
#: Days that a cache entry lives, characters of a question in the analytics.
TTL_DAYS, QUESTION_CHARACTERS = 7, 500


#: The state that a job begins in, and its retries.
BEGIN = ("queued", 0)


def advance(status: str, retries: int, action: str) -> tuple[bool, str, int]:
    """Whether an action is allowed, and the state and retries after it."""
    allowed, to = ACTIONS.get(action, ((), status))
    ok = status in allowed and (action != "retry" or retries < MAX_RETRIES)
    return (ok, to, retries + (action == "retry")) if ok else (ok, status, retries)


def _machine(_job):
    state = list(BEGIN)

    def push(row):
        at, event, action = row
        ok, *state[:] = advance(*state, action)
        return [(at, event, action, ok, *state)]

    return push, lambda: []


def transitions(events: DataFrame) -> DataFrame:
    """Events (job_id, at, event_id, action) with whether the job's state allows them, and the state and
    retries after them. A job begins queued; what isn't allowed changes nothing."""
    rows = events.select("job_id", "at", "event_id", "action")
    return folds.fold(rows, "job_id", ["at", "event_id"], _machine, "job_id bigint, at bigint, event_id bigint, action string, accepted boolean, status string, retries int")


def with_hits(cache: DataFrame, hits: DataFrame, key: str = "cache_key") -> DataFrame:
    """Entries with the hits of a batch added; ``hit_count_before`` is what the reader was shown."""
    added = hits.groupBy(key).agg(F.count(F.lit(1)).alias("__new"))
    out = cache.join(added, key, "left").withColumn("hit_count_before", F.col("hit_count"))
    return out.withColumn("hit_count", F.col("hit_count") + F.coalesce("__new", F.lit(0))).drop("__new")


def without_document(cache: DataFrame, doc: object) -> DataFrame:
    return cache.filter(~F.col("doc").eqNullSafe(F.lit(doc)))


def expired(as_of, days: int = TTL_DAYS) -> Column:
    return F.col("created_at") < F.lit(as_of) - F.expr(f"interval {days} days")


def cleaned(cache: DataFrame, as_of, days: int = TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """The entries that stay, and a row with how many went."""
    gone = cache.agg(F.count_if(expired(as_of, days)).alias("deleted"), F.count_if(~expired(as_of, days)).alias("kept"))
    return cache.filter(~expired(as_of, days)), gone


def logged(queries: DataFrame) -> DataFrame:
    """Analytics rows with their question cut to its longest."""
    return queries.withColumn("question", F.substring("question", 1, QUESTION_CHARACTERS))


def searchable(df: DataFrame, *texts: str, out: str = "fts") -> DataFrame:
    """A derived column for the search grammar: the words of some texts, stemmed."""
    return df.withColumn(out, grammar.words(F.concat_ws(" ", *texts)))


def reloaded(catalog: DataFrame, incoming: DataFrame, reprocess: bool = False, key: str = "file_hash") -> DataFrame:
    """A catalog after an ingest: a known file is rejected, or, to reprocess, replaces the old row."""
    if reprocess:
        return catalog.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)
    return catalog.unionByName(incoming.join(catalog.select(key).distinct(), key, "left_anti"))


def with_assets(old: DataFrame, new: DataFrame, key: str = "asset_id") -> DataFrame:
    """Images or tables appended, ids that are there already left as they are."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def linked(catalog: DataFrame, lines: DataFrame) -> DataFrame:
    """A catalog with links from CSV lines (doc_id,url); blank ones are skipped."""
    row = F.from_csv("line", "doc_id string, url string", {"mode": "PERMISSIVE"})
    links = lines.select(row.alias("r")).select("r.*").filter("trim(coalesce(doc_id, '')) <> '' and trim(coalesce(url, '')) <> ''")
    links = links.groupBy(F.trim("doc_id").cast("long").alias("__id")).agg(F.max(F.trim("url")).alias("link"))
    return catalog.join(links, catalog["id"] == links["__id"], "left").drop("__id")
