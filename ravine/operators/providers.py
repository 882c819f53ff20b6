"""Steps that ask an outside model or store, as protocols with deterministic offline defaults.

A provider works on batches of plain values and runs inside Arrow batches; where it gives nothing,
or nothing valid, the rule that each step names takes over.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ravine.functions import text as T

EMBED_BATCH, SUMMARY_BATCH = 100, 5


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Vowels:
    """The offline embedder: the shares of five letters in a text."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[t.count(c) / max(len(t), 1) for c in "aeiou"] for t in texts]


def embedded(df: DataFrame, text: str, id_: str = "id", provider: Embedder | None = None, size: int = EMBED_BATCH) -> DataFrame:
    """(id, embedding, batch): texts go to the provider ``size`` at a time; batch is the call's size."""
    provider = provider or Vowels()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                made = provider.embed([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.float64())), pa.array([part.num_rows] * part.num_rows, pa.int32())], names=["id", "embedding", "batch"])

    return df.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, embedding array<double>, batch int")


def valid_topics(answer: Column, known: list[str], rule: Column) -> Column:
    """A tagger's answer (topics with commas) cut to the known topics; the rule's where none is left."""
    given = F.transform(F.split(F.lower(F.coalesce(answer, F.lit(""))), ","), lambda t: F.btrim(t))
    kept = F.array_distinct(F.filter(given, lambda t: t.isin(*known)))
    return F.when(F.size(kept) > 0, kept).otherwise(rule)


def sub_questions(question: Column, answer: Column | None = None, most: int = 4) -> Column:
    """A decomposer's questions, the first four; the rule cuts at question marks and " and "."""
    parts = F.transform(F.split(question, r"\?|\s+and\s+"), lambda s: F.btrim(s, F.lit(" \n\t")))
    rule = F.filter(parts, lambda s: F.length(s) > 0)
    rule = F.when(F.size(rule) > 0, rule).otherwise(F.array(question))
    given = rule if answer is None else F.when(F.size(F.coalesce(answer, F.array().cast("array<string>"))) > 0, answer).otherwise(rule)
    return F.slice(given, 1, most)


def variants(question: Column, answer: Column | None = None) -> Column:
    """A router's query variants; the question alone without an answer."""
    return F.array(question) if answer is None else F.when(F.size(F.coalesce(answer, F.array().cast("array<string>"))) > 0, answer).otherwise(F.array(question))


def rewritten(question: Column, answer: Column, least: int = 10) -> Column:
    """A rewriter's query without its quotes; the question where that is too short."""
    return F.when(F.length(F.coalesce(answer, F.lit(""))) < least, question).otherwise(answer)


def first_sentence(content: Column, longest: int = 200) -> Column:
    """The offline summary: the first sentence, cut with an ellipsis."""
    return T.ellipsis(F.btrim(F.regexp_extract(content, r"^([^.!?\n]*)", 1)), longest)


def reranked(found: DataFrame, scores: DataFrame | None = None, k: int = 15, by: str = "query_id") -> DataFrame:
    """Fused rows by a reranker's scores (query, id, rerank), the best first; rows without one, and
    all where there is no reranker, keep the fused order behind them."""
    from pyspark.sql import Window

    out = found.withColumn("rerank", F.lit(None).cast("double")) if scores is None else found.join(scores, [by, "id"], "left")
    w = Window.partitionBy(by).orderBy(F.col("rerank").desc_nulls_last(), F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Store(Protocol):
    def url(self, key: str) -> str: ...


def asset_key(doc: Column, kind: str, page: Column, number: Column, suffix: str = "png") -> Column:
    """The object key of a document's asset."""
    return F.concat(doc.cast("string"), F.lit(f"/{kind}s/page_"), F.format_string("%04d", page), F.lit("_"), F.format_string("%03d", number), F.lit(f".{suffix}"))


def write_objects(df: DataFrame, path: str, key: str = "key") -> DataFrame:
    """A store in a folder all can reach: objects (key, content) as a table sorted by key, and the
    keys with their URLs."""
    df.select(key, "content").repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return df.select(key, F.concat(F.lit(f"{path.rstrip('/')}/"), key).alias("url"))


def read_objects(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Objects of a store, all or those of ``keys``."""
    out = spark.read.parquet(path)
    return out if keys is None else out.join(keys.select(key).distinct(), key, "left_semi")


def hmac_sha256(message: Column, secret: str) -> Column:
    """The keyed digest of a text (RFC 2104) in hexadecimal; the secret is a literal of the plan."""
    import hashlib

    raw = secret.encode()
    block = (raw if len(raw) <= 64 else hashlib.sha256(raw).digest()).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def signed_url(url: Column, key: Column, secret: str, now: Column, seconds: int = 3600) -> Column:
    """A URL that holds until ``seconds`` after ``now`` (seconds since 1970), an hour by default."""
    until = (now.cast("long") + seconds).cast("string")
    return F.concat(url, F.lit("?expires="), until, F.lit("&signature="), hmac_sha256(F.concat_ws("\n", key, until), secret))


def is_signed(signed: Column, key: Column, secret: str, now: Column) -> Column:
    """Whether a signed URL is of this key and still holds; null and other URLs don't."""
    until, given = F.regexp_extract(signed, r"\?expires=(\d+)&", 1), F.regexp_extract(signed, r"&signature=([0-9a-f]{64})$", 1)
    return F.coalesce((given == hmac_sha256(F.concat_ws("\n", key, until), secret)) & (F.try_to_number(until, F.lit("9" * 18)) >= now), F.lit(False))


def delete_objects(spark: SparkSession, path: str, to: str, documents: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """A store without the assets of some documents: the objects that stay, written to ``to``, and how many
    of each document went (0 where it had none)."""
    gone, of = documents.select(F.col(doc).cast("string").alias("__doc")).distinct(), F.substring_index("key", "/", 1)
    objects = spark.read.parquet(path)
    objects.withColumn("__doc", of).join(gone, "__doc", "left_anti").drop("__doc").repartitionByRange("key").sortWithinPartitions("key").write.parquet(to)
    counted = objects.groupBy(of.alias("__doc")).agg(F.count(F.lit(1)).alias("deleted"))
    return spark.read.schema(objects.schema).parquet(to), gone.join(counted, "__doc", "left").select(F.col("__doc").alias(doc), F.coalesce("deleted", F.lit(0)).alias("deleted"))
