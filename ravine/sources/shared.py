"""The folder that driver and executors share, and tables kept there for a while."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster set it; in a session of one process without one, as in
    tests, a folder of this machine."""
    at, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not at and (master == "local" or master.startswith("local[")):
        at = spark.conf.get("ravine.shared.dir", None) or tempfile.mkdtemp(prefix="ravine-")
        spark.conf.set("ravine.shared.dir", at)
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table whose files make fewer tasks than there are cores, dealt over all of them: for work
    that costs more than moving the rows. Larger tables stay as they are. Plain scans only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
