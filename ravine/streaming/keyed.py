"""Keyed state with timers: job feeds, job states and spaced times over micro-batches.

State lives in the state store, from batch to batch and from one start to the next; a batch brings a
key's new rows only, which are taken in their order. Keys are dealt into pages, whose states are one
value each: the number of calls to the store grows with the pages, not with the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ravine.operators import state as jobs
from ravine.streaming import streams

#: States in which a job is still at work, and how long ended ones stay in sight.
ACTIVE = ["queued", "processing"]
VISIBLE_MS = 5 * 60 * 1000
#: Rows of one page over the whole run; pages at least.
PAGE_ROWS, PAGES = 16384, 64


#: A partition's store holds a few pages: small buffers, and a bound for all stores of a process.
SMALL = {"rocksdb.writeBufferSizeMB": "2", "rocksdb.boundedMemoryUsage": "true", "rocksdb.maxMemoryUsageMB": "256", "maintenanceInterval": "5s"}


@contextmanager
def state_store(spark: SparkSession):
    """The store that typed state needs, for the streams started inside."""
    want = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.changelogCheckpointing.enabled": "true", "rocksdb.allowFAllocate": "false"} | SMALL
    want = {f"spark.sql.streaming.stateStore.{k}": v for k, v in want.items()}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Paged(StatefulProcessor):
    """The states of a page of keys, as one value: a call to the store costs more than a key's rows do, so
    pages are read and written whole. A page has as many keys as fit its rows (see ``pages``)."""

    names: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "states binary")

    def read(self) -> dict:
        """Each key's state, a tuple."""
        held = self.held.get()
        columns = [c.to_pylist() for c in pa.ipc.open_stream(held[0]).read_all().columns] if held else [[]]
        return dict(zip(columns[0], zip(*columns[1:])))

    def write(self, states: dict) -> None:
        if not states:
            self.held.clear()
            return
        table, sink = pa.table([list(states), *zip(*states.values())], names=["key", *self.names]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass


def _keys(column: pd.Series) -> list:
    """Null keys have a page of their own."""
    return column.astype(object).where(column.notna(), None).tolist()


class Feed(Paged):
    """Sends a job's update when it differs from the last one sent. Active jobs are always in sight, ended
    ones until five minutes after their update; then a timer forgets them. A page's timer stands at
    the first time at which one of its jobs is to be forgotten."""

    names = ["updated_ms", "ended"]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["polled_ms", "event_id"])
        sent, out = self.read(), []
        for at, (job, updated, polled, status) in enumerate(zip(_keys(new["job_id"]), new["updated_ms"].tolist(), new["polled_ms"].tolist(), new["status"].tolist())):
            ended, last = status not in ACTIVE, sent.get(job)
            if ended and updated <= polled - VISIBLE_MS or last and last[0] == updated:
                continue
            sent[job] = (int(updated), ended)
            out.append(at)
        if out:
            self.write(sent)
            self.wait(sent)
        yield new.iloc[out][["job_id", "event_id", "status", "updated_ms", "polled_ms"]]

    def wait(self, sent: dict) -> None:
        first = min((updated for updated, ended in sent.values() if ended), default=None)
        if first is not None:
            self.handle.registerTimer(first + VISIBLE_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, sent = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self.read()
        kept = {job: (updated, ended) for job, (updated, ended) in sent.items() if not ended or updated + VISIBLE_MS > now}
        if len(kept) < len(sent):
            self.write(kept)
        self.wait(kept)
        return iter(())


class Machine(Paged):
    """Jobs' states from their actions; see ``state.ACTIONS``."""

    names = ["status", "retries"]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "event_id"])
        states, steps = self.read(), []
        for job, action in zip(_keys(new["job_id"]), new["action"].tolist()):
            ok, status, retries = jobs.advance(*states.get(job, jobs.BEGIN), action)
            states[job] = (status, retries)
            steps.append((ok, status, retries))
        self.write(states)
        yield new[["job_id", "at", "event_id", "action"]].assign(accepted=[s[0] for s in steps], status=[s[1] for s in steps], retries=[s[2] for s in steps])


class Spaced(Paged):
    """A key's times that are more than ``gap`` after the last one kept."""

    names = ["at"]

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("at")
        kept, out = self.read(), []
        for i, (of, at) in enumerate(zip(_keys(new["key"]), new["at"].tolist())):
            last = kept.get(of)
            if last is None or at - last[0] > self.gap:
                kept[of] = (int(at),)
                out.append(i)
        if out:
            self.write(kept)
        yield new.iloc[out][["key", "at"]]


def pages(rows: DataFrame) -> int:
    """How many pages a table's keys are dealt into: one for each ``PAGE_ROWS`` rows over the whole run. A
    checkpoint keeps its number."""
    return max(PAGES, rows.count() // PAGE_ROWS)


def _paged(rows: DataFrame, key: str, n: int):
    """The rows by page of their keys."""
    page = F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(key), F.lit(n)))
    return rows.withColumn("page", page).groupBy("page")


def feed(updates: DataFrame, n: int = PAGES) -> DataFrame:
    """Updates (job_id, event_id, status, updated_ms, polled_ms) as they were polled, to those sent; the jobs'
    states lie in n pages.

    The clock is the time of polling, so an update may be as old as it likes: only ended jobs have
    to be recent."""
    clock = updates.withColumn("clock", F.timestamp_millis("polled_ms")).withWatermark("clock", "1 minute")
    return _paged(clock, "job_id", n).transformWithStateInPandas(Feed(), "job_id bigint, event_id bigint, status string, updated_ms bigint, polled_ms bigint", "Append", "EventTime")


def transitions(events: DataFrame, n: int = PAGES) -> DataFrame:
    """``state.transitions`` over a stream whose batches come in order."""
    rows = events.select("job_id", "at", "event_id", "action")
    return _paged(rows, "job_id", n).transformWithStateInPandas(Machine(), "job_id bigint, at bigint, event_id bigint, action string, accepted boolean, status string, retries int", "Append", "none")


def spaced(times: DataFrame, gap: int, n: int = PAGES) -> DataFrame:
    """``folds.spaced`` over a stream (key, at) whose batches come in order."""
    return _paged(times, "key", n).transformWithStateInPandas(Spaced(gap), f"key {times.schema['key'].dataType.simpleString()}, at bigint", "Append", "none")


def in_batches(rows: DataFrame, number: str, n: int, make: Callable[[DataFrame], DataFrame], at: str, order: list | None = None) -> DataFrame:
    """A table cut by its column ``number`` (0 to n - 1) and fed batch after batch to the stream that
    ``make`` builds, started anew for each on one checkpoint: what it wrote, with its batch.

    ``order``: rows of a batch are written in this order (see ``streams.run``)."""
    spark = rows.sparkSession
    rows.write.partitionBy(number).parquet(f"{at}/cut")
    schema = rows.drop(number).schema
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{at}/feed/none"))
    with state_store(spark):
        for b in range(n):
            if fs.exists(path(f"{at}/cut/{number}={b}")):
                fs.rename(path(f"{at}/cut/{number}={b}"), path(f"{at}/feed/rows-{b:06d}"))
            out = make(spark.readStream.schema(schema).parquet(f"{at}/feed/*"))
            streams.run(out, f"{at}/checkpoint", f"{at}/table", order=order)
    return spark.read.schema(out.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(f"{at}/table")
