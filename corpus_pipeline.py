"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``; other
columns of docs are dropped, whatever their names. An empty table gives an empty one in each stage,
and texts are worked on whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ravine.llm import common, mixing, quality, sharding, simhash, templates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive thresholds keep.

    Null and empty texts go (no word), rows repeated are judged each; null languages and sources are
    groups like any other.
    """
    return quality.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a similarity of 0.8 or more,
    that with the smallest doc_id.

    Texts without a word are one group; a null doc_id is the smallest only where there is no other;
    of rows repeated in doc_id and text one stays.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; rows repeated go or stay together; an empty benchmark drops nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = common.materialize(templates.leaks(docs, benchmark).select(F.col("rk").alias("__leak")).distinct(), "leaks")
    keyed = docs.select(*COLUMNS).withColumn("__rk", common.row_key("doc_id", "text"))
    return keyed.join(found, F.col("__rk") == F.col("__leak"), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence of the mix: a row for each copy that it takes, in training order.

    Null texts and those without a word have size 0; null sources are one source, ranked last; of
    equal positions the smaller doc_id comes first.
    """
    return mixing.curriculum(mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS, "positions")).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, slot and digest. Copies and rows repeated get slots of their own."""
    rows = docs.select(*COLUMNS, sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"))
    return sharding.shard(rows, order=["doc_id", "text_crc32", "size"])


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("mixing_sources", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the fingerprints' links; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's own tables go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.recorded() as made:
        for name, stage in STAGES[:-1]:
            docs = common.materialize(stage(spark, docs, sf_dir), name)
            for path in made[:-1]:  # the last is this stage's result
                common.remove(spark, path)
            del made[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
