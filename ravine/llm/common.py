"""What the operators share: the shared folder, materialising, keys for rows, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters as bytes.
SPACES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the cluster set it.

    Only where the session has none and runs in one process, as in tests, a folder of this machine
    is made, once a session; a cluster must name one.
    """
    at, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not at and (master == "local" or master.startswith("local[")):
        at = spark.conf.get("ravine.shared.dir", None) or tempfile.mkdtemp(prefix="ravine-")
        spark.conf.set("ravine.shared.dir", at)
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def recorded():
    """The scratch paths that this thread makes inside, as a list; so that superseded ones can go."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path, made = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", _made.get()
    if made is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Hadoop, wherever it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends at files all can read.

    The shuffle files of the write go as soon as it has ended; nothing reads them again.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch(spark, name), spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> Column:
    """64 bits that tell rows apart together with their id; never null."""
    return F.xxhash64(F.lit(17), *(F.col(c) for c in cols))


def n_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over the whole table."""
    return df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0


def partitions(spark: SparkSession, total: int, each: int = 32 << 20) -> int:
    """So many partitions that each has about ``each`` bytes; the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each), 1)


@contextmanager
def shuffles(spark: SparkSession, n: int):
    """Joins and aggregates planned inside deal to n partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def write_frames(df: DataFrame, path: str, end: str) -> None:
    """Write a binary column as raw files, each value followed by ``end`` (ASCII).

    Spark's own text writer does it, so the files go to any file system that Spark knows and are
    committed task by task; a lost executor's tasks simply run again.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.select(F.col(df.columns[0]).cast("string").alias("value")).write.option("lineSep", end).text(path)
    finally:
        spark.conf.set(key, before)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the raw files below ``path``; a task for each large file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
