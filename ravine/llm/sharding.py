"""Reproducible shuffle and sharding by a Feistel permutation over global row numbers.

Law: ``rows`` — the row counts of any two shards differ by one at most.

Rows get global numbers without a global sort: a fixed number of hash buckets, the rows before
each bucket from a running sum over the bucket counts, and the place within the bucket. A Feistel
network over ``a * b >= n`` (a, b about the square root of n) permutes the numbers; what falls
outside ``n`` walks on along its cycle. Shard and slot are the remainder and the quotient of the
permuted number, so either can be computed from a row number alone. All of it is DataFrame
functions: no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Hash buckets for numbering rows. Fixed, so that the table of their offsets is bounded.
BUCKETS = 4096
ROUNDS = 6


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add ``out``: a number from 0 to n-1 for each row, the same in every run.

    ``order`` names the columns that tell rows apart, the first of which chooses the bucket. Rows
    equal in all of them are interchangeable. Null is a value like any other.
    """
    bucket = F.pmod(F.xxhash64(F.col(order[0])), F.lit(BUCKETS)).cast("int")
    counts = df.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    return (
        df.withColumn("__bucket", bucket)
        .withColumn("__place", F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(offsets), "__bucket")  # BUCKETS rows at most
        .withColumn(out, F.col("__before") + F.col("__place"))
        .drop("__bucket", "__before", "__place")
    )


def radices(n: int) -> tuple[int, int]:
    """The sides of the smallest nearly square grid with n cells at least."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over ``x``, a number below a * b.

    One expression: its rounds share their subexpressions, which are evaluated once a row.
    """
    right = F.pmod(x, F.lit(b))
    left = F.call_function("div", x, F.lit(b))
    for i in range(ROUNDS):
        if i % 2:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), left), F.lit(b)), F.lit(b))
        else:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), right), F.lit(a)), F.lit(a))
    return left * b + right


def _walks(spark: SparkSession, n: int, a: int, b: int, seed: int) -> int:
    """How many more passes bring every number back below n.

    Only numbers from n to a * b - 1 (about the square root of n) can need one, and of these about
    one stays outside in a pass. They are taken to the driver after each pass: in one plan, the
    filter would be pushed through the passes and its expression multiplied by every one.
    """
    outside, k = spark.range(n, a * b).select(F.col("id").alias("__p")), 0
    if a * b == n:
        return 0
    while True:
        k += 1
        left = [r[0] for r in outside.select(_feistel(F.col("__p"), a, b, seed).alias("__p")).filter(F.col("__p") >= n).collect()]
        if not left:
            return k
        outside = spark.range(1).select(F.explode(F.array(*(F.lit(x).cast("long") for x in left))).alias("__p"))


def permute(df: DataFrame, n: int, number: str, out: str, seed: int) -> DataFrame:
    """Add ``out``: the place of row ``number`` in a pseudo-random order of n rows."""
    a, b = radices(n)
    first, walks = _feistel(F.col(number), a, b, seed), _walks(df.sparkSession, n, a, b, seed)
    if not walks:
        return df.withColumn(out, first)
    # a walk's number is bound as the lambda's argument: a filter on the place may be pushed through
    # this, and would multiply the expression of one column after another
    on = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda x, _: F.when(x < n, x).otherwise(_feistel(x, a, b, seed)))
    return df.withColumn(out, F.when(first < n, first).otherwise(on))


def text_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard(df: DataFrame, n_shards: int = 16, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """Add ``row_number``, ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in a shard).

    ``order`` tells rows apart (default: all columns). Nulls, empty texts, repeated rows and an
    empty table need no special care: repeated rows get numbers of their own. Texts are never looked
    into, so their length doesn't matter. Columns that have one of the added names are replaced.
    """
    df = df.drop("row_number", "shard", "slot")
    n = df.count()
    df = number_rows(df, order or df.columns, "row_number")
    df = permute(df, max(n, 1), "row_number", "__place", seed)
    return df.withColumns({"shard": (F.col("__place") % n_shards).cast("int"), "slot": F.expr(f"__place div {n_shards}")}).drop("__place")


def shard_documents(documents: DataFrame, n_shards: int = 16, seed: int = 42) -> DataFrame:
    """The digest of a sharding of ``documents``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    small = documents.select("doc_id", text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    out = shard(small, n_shards, seed, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def write_shards(df: DataFrame, path: str, n_shards: int = 16, seed: int = 42, order: list[str] | None = None) -> None:
    """Write the shards as folders of Parquet files, rows in slot order."""
    out = shard(df, n_shards, seed, order)
    out.repartition("shard", (F.col("slot") / 1_000_000).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
