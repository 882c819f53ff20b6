"""Structured Streaming: rollups, sessions, change feed. Event times must be TIMESTAMP, not NTZ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ravine.functions import grammar


def read_events(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A Parquet folder or file as a stream, ``ts`` as TIMESTAMP; so many files a batch."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        stream, path = stream.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return stream.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_cost(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days by type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def changes(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (job, updated_at) once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id", "ts"])


def pages(segments: DataFrame, late: str = "1 hour") -> DataFrame:
    """60-second pages of a transcript."""
    return segments.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def words(rows: DataFrame, column: str) -> DataFrame:
    """A derived search column, kept up by a stream as rows come."""
    return rows.withColumn("fts", grammar.words(column))


def visible(jobs: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Updates of jobs: active ones always, ended ones only if they are no older than the watermark."""
    seen = jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "ts"])
    return seen.select("job_id", "status", "ts")


def run(df: DataFrame, checkpoint: str, path: str, mode: str = "append", order: list | None = None) -> str:
    """Run a stream over all that is there into Parquet below ``path``; returns ``path``.

    Each batch is written under its own number, so one that is repeated after a failure overwrites
    itself, and a second run goes on where the first ended. In complete mode the last batch is the
    result. ``order``: rows of a batch are written in this order, as a queue drained by priority.
    """
    complete = mode == "complete"

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.orderBy(*order) if order else batch
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{'all' if complete else f'part-{number:010d}'}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return path


def places(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``run`` wrote with an order, each row with its place in its batch (from 1): its row in the
    file after the rows of the files before. Only the files' sizes are added up in one place."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = rows.groupBy("batch", "file").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("batch", "file", F.coalesce(F.sum("n").over(Window.partitionBy("batch").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, ["batch", "file"]).withColumn("place", F.col("before") + F.col("row") + 1).drop("before", "row", "file")


def to_table(df: DataFrame, checkpoint: str, path: str, mode: str = "complete") -> DataFrame:
    """``run``, and its result as a table."""
    run(df, checkpoint, path, mode)
    return df.sparkSession.read.schema(df.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(path)
