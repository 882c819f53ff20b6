"""Sources and sinks: tables, the logical views over them, appends, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ravine.sources.shared import spread

#: The topics in their declared order.
TOPICS = ["system_database", "multi_tier_architecture", "graphics", "provisioning", "troubleshooting", "configuration", "hardware", "hvac_systems", "energy_management", "integration"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The chunk table: id, doc_id, content, page_number, section_id, topic, topics, embedding.

    ``dealt``: for work on the texts, over all cores (see ``spread``).
    """
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    d = spread(d, "doc_id") if dealt else d
    names = F.array(*map(F.lit, TOPICS))
    topic = F.get(names, F.col("label"))
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("doc_id"),
        F.col("text").alias("content"),
        (F.floor(F.col("doc_id") / 20)).cast("int").alias("page_number"),
        F.concat_ws("_", "source", "lang").alias("section_id"),
        topic.alias("topic"),
        F.when(F.col("label").isNotNull(), F.array_distinct(F.array(topic, F.get(names, ((F.col("label") + 3) % 10).cast("int"))))).alias("topics"),
        "embedding",
        "lang",
    )


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: id, title (the first line), summary (the text stands in), type, language, hash and size."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("summary"),
        F.col("source").alias("document_type"),
        F.col("lang").alias("language"),
        F.sha2(F.col("text"), 256).alias("file_hash"),
        F.col("n_chars").alias("file_size_bytes"),
    )


def append_new(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Append the rows whose key isn't there yet (conflict: ignore)."""
    return old.unionByName(new.join(old, key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both; where both have a key the new values hold, but ``keep`` columns stay and nulls
    don't overwrite."""
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}") if c in keep or c == key else F.coalesce(f"b.{c}", f"a.{c}")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*(pick(c).alias(c) for c in old.columns))


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str):
    """New snapshots without the ids in ``gone``, and how many rows each table loses.

    ``children``: name to (table, its foreign key). Returns (parents, children, counts).
    """
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    drop = lambda t, k, how: t.join(ids, t[k] == ids["__gone"], how)
    kept = {n: drop(t, k, "left_anti") for n, (t, k) in children.items()}
    counts = None
    for n, (t, k) in {"parents": (parents, key), **children}.items():
        one = drop(t, k, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(n).alias("name"), "deleted")
        counts = one if counts is None else counts.unionByName(one)
    return drop(parents, key, "left_anti"), kept, counts


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of doc_id and url, without blank rows."""
    return spark.read.csv(path, header=True, schema="doc_id string, url string").filter("trim(coalesce(doc_id, '')) <> '' and trim(coalesce(url, '')) <> ''")


def write_report(df: DataFrame, path: str) -> None:
    """A JSON results sink."""
    df.write.mode("overwrite").json(path)
