"""Valid-time enrichment of sales: each sale meets the client's version that was valid when it was sold.

A client's versions cut time into segments: a version's segment begins at its ``valid_at`` and ends at
the next version's. A segment owns the waiting sales of its span; sales before the first version
belong to the segment before it. A version that arrives splits the segment it falls into: it takes
over the sales from its own time on. The horizon H drains the sales before it, from whichever
segment owns them, and then all but a client's last version up to H are deleted; their segments are
empty by then.

The segments are the MapState of a Structured Streaming query (``transformWithStateInPandas``), which
is started anew for each batch on one checkpoint. A call to the state costs about 0.4 ms from Python,
so an entry of the map isn't one segment but a leaf of up to ``LEAF`` neighbouring segments with the
sales that they own. The grouping key is a page: some ``PAGE_ROWS`` rows over the whole run, dealt by
a hash of the client.

A client with more than one in ``SHARE`` of all rows would fill pages, so its time is cut into slices
of equal width, each on a page of its own; at most ``SHARE`` clients can be so large, hence their list
is small enough to broadcast, and there are fewer than twice as many slices. What a slice can't know
by itself comes with the batch as one row a slice: the last version before it, how many versions the
client's other slices hold, and whether a later slice has a version up to H. These rows come from the
slices' own summaries after the batch before, and the new versions counted by slice.

Nulls and odd rows: sales without a client have no versions and wait like others; sales without a
time are emitted when they arrive and take no version; changes without ``valid_at`` are ignored, those
without a client have no effect unless they are late; a null seq or change_id comes before others. Rows
without a time of arrival go into the last batch, those before the first day into the first. Sales
repeated are emitted each, changes repeated in every column count once. An empty table gives what
the other one makes. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ravine.llm.common import scratch, shared_dir

#: Segments in one entry of the map; rows of one page over the whole run; pages at least.
LEAF, PAGE_ROWS, PAGES = 1024, 16384, 64
#: A client with more than one in so many rows is sliced.
SHARE = 1024
#: How far behind the largest time of earlier batches a table's watermark stands, in microseconds.
DELAY = 36 * 3_600_000_000
#: Before all times.
NEVER = -(1 << 63)

SALE, CHANGE, PAGE, SLICE = range(4)
NO_TIME, NO_ID, NO_CENTS, NO_BASE = 1, 2, 4, 8
FEED = "page bigint, kind int, client bigint, slice int, id bigint, at bigint, seq bigint, cents bigint, op string, nulls int, held bigint, gone boolean"
OUT = "rec int, batch bigint, id bigint, id_nulls int, n_held bigint, change_id bigint, cents bigint, op string, nulls int, client bigint, slice int, first_at bigint, at bigint, seq bigint"
VERSION = ["client", "slice", "at", "seq", "id", "cents", "op", "nulls"]
WAITING = ["client", "slice", "at", "id", "nulls"]


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time without a zone."""
    clock = (F.hour(at) * 60 + F.minute(at)).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return F.unix_date(at.cast("date")).cast("long") * 86_400_000_000 + clock


def number(day: Column, batches: int, first: int, days: int) -> Column:
    """The batch of a day since 1970."""
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first) * batches / F.lit(days)))).cast("int")


def _frame(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _bytes(df: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(df, preserve_index=False), pa.BufferOutputStream()
    table = table.set_column(table.schema.get_field_index("op"), "op", table["op"].cast(pa.string())) if "op" in df else table
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Segments(StatefulProcessor):
    """The segments of one page, over one batch."""

    def __init__(self, batch: int, late: int, horizon: int, last: bool) -> None:
        """Changes before ``late`` are late; sales before ``horizon`` are emitted, all if it's the last."""
        self.batch, self.late, self.horizon, self.last = batch, late, horizon, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.leaves = handle.getMapState("segments", "leaf int", "versions binary, sales binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r for r in rows if len(r)], ignore_index=True)
        held = [(k[0], _frame(v), _frame(s)) for k, (v, s) in self.leaves.iterator()]
        is_late = (new["kind"] == CHANGE) & (new["at"] < self.late)
        late, slices = new[is_late], new[new["kind"] == SLICE]
        fresh = new.loc[(new["kind"] == CHANGE) & ~is_late & (new["slice"] >= 0), VERSION]
        versions = pd.concat([*(v for _, v, _ in held), fresh], ignore_index=True)
        order = np.lexsort([versions[c].to_numpy() for c in ("id", "seq", "at", "slice", "client")])
        versions = versions.iloc[order].reset_index(drop=True)
        sales = pd.concat([*(s for _, _, s in held), new.loc[new["kind"] == SALE, WAITING]], ignore_index=True)
        owner, unit_v, unit_s, unit_t = self.split(versions, sales, slices)
        counts = np.bincount(unit_v, minlength=max(np.concatenate([unit_v, unit_s, unit_t]), default=-1) + 1)

        timeless = (sales["nulls"].to_numpy() & NO_TIME) > 0
        ready = timeless | (sales["at"].to_numpy() < self.horizon) | self.last
        told = np.full(len(counts), -1)  # the slice's row of each unit that is a slice
        told[unit_t] = np.arange(len(slices))
        yield from self.drained(sales, versions, slices, ready, timeless, owner, counts, unit_s, told)
        if len(late):
            yield self.out(rec=CHANGE, id=late["id"], id_nulls=late["nulls"] & NO_ID)
        if not self.last:
            passed = versions["at"].to_numpy() <= self.horizon
            after = np.append(passed[1:] & (unit_v[1:] == unit_v[:-1]), False) if len(versions) else passed
            gone = np.append(slices["gone"].to_numpy(dtype=bool), False)[told[unit_v]]
            stay = ~(passed & (after | gone))
            kept = np.cumsum(stay) - 1  # where a version is afterwards
            owner = np.where(owner >= 0, kept[owner], -1) if len(versions) else owner
            versions, unit_v = versions[stay], unit_v[stay]
            self.put(versions, sales[~ready], owner[~ready], [k for k, _, _ in held])
        if len(slices):
            yield self.summaries(versions, slices, unit_v, unit_t)

    @staticmethod
    def split(versions: pd.DataFrame, sales: pd.DataFrame, slices: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Each sale's segment (the row of its version, -1 before the first), and the units (client and
        slice) of versions, sales and slice rows, numbered."""
        n, m = len(versions), len(sales)
        both = [np.concatenate([f[c].to_numpy() for f in (versions, sales, slices)]).astype(np.int64) for c in ("client", "slice", "at")]
        both[2][n : n + m][(sales["nulls"].to_numpy() & NO_TIME) > 0] = NEVER
        kind = np.repeat([0, 1, 2], [n, m, len(slices)])
        kind[n : n + m][both[2][n : n + m] == NEVER] = -1  # no version is at or before no time
        order = np.lexsort([np.arange(len(kind)), kind, both[2], both[1], both[0]])
        client, part = both[0][order], both[1][order]
        begins = np.append(True, (client[1:] != client[:-1]) | (part[1:] != part[:-1]))[: len(order)]
        unit = np.empty(len(order), np.int64)
        unit[order] = np.cumsum(begins) - 1
        version = np.where(order < n, order, -1)
        seen = np.empty(len(order), np.int64)
        seen[order] = np.maximum.accumulate(version) if len(order) else version
        owner, unit_v, unit_s = seen[n : n + m], unit[:n], unit[n : n + m]
        if n:
            owner = np.where((owner >= 0) & (unit_v[owner] == unit_s), owner, -1)
        return owner, unit_v, unit_s, unit[n + m :]

    def out(self, **columns: object) -> pd.DataFrame:
        names = [x.split()[0] for x in OUT.split(", ")]
        n = len(columns["id"])
        return pd.DataFrame({c: np.asarray(columns[c]) if c in columns else np.full(n, None if c == "op" else 0) for c in names} | {"batch": np.full(n, self.batch), "rec": np.full(n, columns["rec"])})[names]

    def drained(self, sales, versions, slices, ready, timeless, owner, counts, unit, told) -> Iterator[pd.DataFrame]:
        """The sales that H has passed, with the versions of their segments."""
        if not ready.any():
            return
        sales, owner, unit = sales[ready], owner[ready], unit[ready]
        tick = told[unit]
        source = pd.concat([versions[["id", "cents", "op", "nulls"]], slices[["id", "cents", "op", "nulls"]]], ignore_index=True)
        none = pd.DataFrame({"id": [0], "cents": [0], "op": [None], "nulls": [NO_ID | NO_CENTS | NO_BASE]})
        source = pd.concat([source, none], ignore_index=True)
        at = np.where(owner >= 0, owner, np.where((tick >= 0) & ~timeless[ready], len(versions) + tick, len(source) - 1))
        others = np.append(slices["held"].to_numpy(dtype=np.int64), 0)[tick]
        base = source.iloc[at]
        yield self.out(rec=SALE, id=sales["id"], id_nulls=sales["nulls"] & NO_ID, n_held=counts[unit] + others, change_id=base["id"], cents=base["cents"], op=base["op"], nulls=base["nulls"])

    def put(self, versions: pd.DataFrame, sales: pd.DataFrame, owner: np.ndarray, before: list[int]) -> None:
        """Write the leaves; a segment's sales lie in its leaf, those before any version in the first."""
        leaves = -(-len(versions) // LEAF) or int(len(sales) > 0)
        order = np.argsort(owner, kind="stable")
        sales, leaf = sales.iloc[order], np.maximum(owner[order], 0) // LEAF
        for i in range(leaves):
            self.leaves.updateValue((i,), (_bytes(versions.iloc[i * LEAF : (i + 1) * LEAF]), _bytes(sales[leaf == i])))
        for i in before:
            if i >= leaves:
                self.leaves.removeKey((i,))

    def summaries(self, versions: pd.DataFrame, slices: pd.DataFrame, unit_v: np.ndarray, unit_t: np.ndarray) -> pd.DataFrame:
        """Of each slice with versions: how many, the first time, the last version."""
        first, end = np.searchsorted(unit_v, unit_t), np.searchsorted(unit_v, unit_t, "right")
        some = end > first
        first, end, slices = first[some], end[some], slices[some]
        last = versions.iloc[end - 1]
        return self.out(
            rec=SLICE, id=slices["id"], n_held=end - first, change_id=last["id"], cents=last["cents"], op=last["op"], nulls=last["nulls"],
            client=slices["client"], slice=slices["slice"], first_at=versions["at"].iloc[first], at=last["at"], seq=last["seq"],
        )


@contextmanager
def _state_store(spark: SparkSession):
    """MapState needs the RocksDB store; its changes are kept batch by batch and its files take the disk that
    they fill. A store closes with its task, so an executor has as many as cores. They share one cache and one
    bound on buffers: Spark never frees a store's own cache, so each start would leave one behind a partition.
    Checksums of the checkpoint's files would cost four threads a store, and the checkpoint is scratch."""
    want = {
        "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "rocksdb.changelogCheckpointing.enabled": "true",
        "rocksdb.allowFAllocate": "false",
        "rocksdb.boundedMemoryUsage": "true",
        "rocksdb.maxMemoryUsageMB": "256",
        "unloadOnCommit": "true",
        "maintenanceInterval": "10s",
    }
    want = {f"spark.sql.streaming.stateStore.{k}": v for k, v in want.items()} | {"spark.sql.streaming.checkpoint.fileChecksum.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(sales: DataFrame, changes: DataFrame, batches: int, first: int, days: int) -> DataFrame:
    """Both tables as rows of the feed with their batch; client null for sales without one."""
    flag = lambda c, bit: F.when(c.isNull(), F.lit(bit)).otherwise(F.lit(0))
    s = sales.select(
        number(F.unix_date(F.col("arrived_at").cast("date")), batches, first, days).alias("batch"), F.lit(SALE).alias("kind"), F.col("client_id").alias("client"), F.coalesce("sale_id", F.lit(0)).cast("long").alias("id"),
        F.coalesce(micros(F.col("sold_at")), F.lit(0)).alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("cents"), F.lit(None).cast("string").alias("op"),
        (flag(F.col("sold_at"), NO_TIME) + flag(F.col("sale_id"), NO_ID)).alias("nulls"),
    )
    delay = F.coalesce(F.crc32(F.col("change_id").cast("string")) % 4, F.lit(0))
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long")
    c = changes.select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").filter("valid_at IS NOT NULL").distinct()
    c = c.select(
        number(F.unix_date(F.col("valid_at").cast("date")) + delay, batches, first, days).alias("batch"), F.lit(CHANGE).alias("kind"), F.col("client_id").alias("client"), F.coalesce("change_id", F.lit(NEVER)).cast("long").alias("id"),
        micros(F.col("valid_at")).alias("at"), F.coalesce("seq", F.lit(NEVER)).cast("long").alias("seq"), F.coalesce(cents, F.lit(0)).alias("cents"), F.col("op").cast("string").alias("op"),
        (flag(F.col("change_id"), NO_ID) + flag(cents, NO_CENTS)).alias("nulls"),
    )
    return s.unionByName(c)


def _place(rows: DataFrame, share: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows with page and slice; (client, slice, page) of all slices of large clients; pages."""
    spark = rows.sparkSession
    timed = F.when(F.col("nulls").bitwiseAND(NO_TIME) == 0, F.col("at"))
    total, low, high = rows.agg(F.count("*"), F.min(timed), F.max(timed)).first()
    pages, most = max(PAGES, total // PAGE_ROWS), max(total / share, 1)
    # fewer than ``share`` clients can have more than total / share rows
    large = [(r["client"], -(-r["count"] // most)) for r in rows.filter("client IS NOT NULL").groupBy("client").count().filter(F.col("count") > most).collect()]
    parts = spark.createDataFrame([(c, int(n)) for c, n in large], "client bigint, parts int")
    width = (high - low + 1) if total and low is not None else 1
    cut = F.floor((F.col("at") - F.lit(low or 0)).cast("double") * F.col("parts") / F.lit(float(width)))
    part = F.when(F.col("client").isNull(), F.lit(-1)).when(F.col("parts").isNull(), F.lit(0)).when(F.col("nulls").bitwiseAND(NO_TIME) > 0, F.pmod("id", "parts"))
    part = part.otherwise(F.greatest(F.lit(0), F.least(F.col("parts") - 1, cut))).cast("int")
    page = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(pages))
    placed = rows.join(F.broadcast(parts), "client", "left").withColumn("slice", part)
    spot = F.when(F.col("client").isNull(), page(F.lit(-1), F.col("id"))).otherwise(page("client", "slice"))
    slices = parts.select("client", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice")).withColumn("page", page("client", "slice"))
    return placed.withColumn("page", spot).drop("parts"), slices, pages


def _ticks(feed: DataFrame, summaries: DataFrame | None, slices: DataFrame, late: int, horizon: int) -> DataFrame:
    """A row for each slice: the last version before it, versions held elsewhere, whether a later slice
    has one up to H; from the summaries and the batch's new versions. A client's slices are few."""
    fresh = feed.filter((F.col("kind") == CHANGE) & (F.col("at") >= late)).join(F.broadcast(slices.select("client", "slice")), ["client", "slice"], "left_semi")
    version = lambda c: F.struct("at", "seq", F.col(c).alias("id"), "cents", "op", "nulls").alias("v")
    known = fresh.select("client", "slice", F.lit(1).cast("long").alias("n"), F.col("at").alias("first"), version("id"))
    if summaries is not None:
        known = known.unionByName(summaries.select("client", "slice", F.col("n_held").alias("n"), F.col("first_at").alias("first"), version("change_id")))
    known = known.groupBy("client", "slice").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("v").alias("v"))
    w = Window.partitionBy("client")
    by = w.orderBy("slice")
    each = slices.join(known, ["client", "slice"], "left").select(
        "page", "client", "slice",
        F.last("v", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("v"),
        (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.coalesce("n", F.lit(0))).alias("held"),
        F.coalesce(F.min("first").over(by.rowsBetween(1, Window.unboundedFollowing)) <= horizon, F.lit(False)).alias("gone"),
    )
    return each.select(
        "page", F.lit(SLICE).alias("kind"), "client", "slice", F.coalesce("v.id", F.lit(0)).alias("id"), F.coalesce("v.at", F.lit(0)).alias("at"), F.coalesce("v.seq", F.lit(0)).alias("seq"),
        F.coalesce("v.cents", F.lit(0)).alias("cents"), "v.op", F.coalesce("v.nulls", F.lit(NO_ID | NO_CENTS | NO_BASE)).alias("nulls"), "held", "gone",
    )


def enrich(sales: DataFrame, changes: DataFrame, batches: int, first: int, days: int, share: int = SHARE) -> DataFrame:
    """(rec, id, batch, n_held, change_id, balance_cents, op) of every sale and every late change.

    The tables are cut into ``batches`` by day of arrival, from day ``first`` since 1970 over ``days``
    days; changes arrive up to three days after they are valid. See the module for the rest.
    """
    spark = sales.sparkSession
    root = scratch(spark, "valid-time")
    if "://" not in root and not root.startswith("/"):
        raise ValueError(f"{shared_dir(spark)} has to be an absolute path")
    placed, slices, pages = _place(_rows(sales, changes, batches, first, days), share)
    names = [x.split()[0] for x in FEED.split(", ")]
    of = lambda df: df.select("batch", *(F.coalesce(F.col(c), F.lit(0)).alias(c) if c == "client" else F.col(c) for c in names if c in df.columns))
    of(placed).write.partitionBy("batch").parquet(f"{root}/cut")
    cut = spark.read.schema(f"batch int, {FEED}").parquet(f"{root}/cut")
    tops = {(r["batch"], r["kind"]): r["top"] for r in cut.filter(F.col("nulls").bitwiseAND(NO_TIME) == 0).groupBy("batch", "kind").agg(F.max("at").alias("top")).collect()}
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    summaries: DataFrame | None = None
    with _state_store(spark):
        for b in range(batches + 1):
            before = {kind: max((t for (x, k), t in tops.items() if k == kind and x < b), default=None) for kind in (SALE, CHANGE)}
            mark = {k: NEVER if t is None else t - DELAY for k, t in before.items()}
            last, horizon = b == batches, min(mark.values())
            if last:  # nothing arrives: sales go with what the last batch left
                horizon = NEVER
            ticks = _ticks(cut.filter(F.col("batch") == b).drop("batch"), summaries, slices, mark[CHANGE], horizon)
            every = spark.range(pages).select(F.col("id").alias("page"), F.lit(PAGE).alias("kind"), *(F.lit(0).cast("long" if c in ("client", "id", "at", "seq", "cents") else "int").alias(c) for c in ("client", "slice", "id", "at", "seq", "cents", "nulls")))
            ticks.unionByName(every, allowMissingColumns=True).write.parquet(f"{root}/feed/ticks-{b}")
            if fs.exists(path(f"{root}/cut/batch={b}")):
                fs.rename(path(f"{root}/cut/batch={b}"), path(f"{root}/feed/rows-{b}"))
            rows = spark.readStream.schema(FEED).parquet(f"{root}/feed/*")
            query = (
                rows.groupBy("page")
                .transformWithStateInPandas(Segments(b, mark[CHANGE], horizon, last), OUT, "Append", "none")
                .writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
            summaries = spark.read.schema(OUT).parquet(f"{root}/out").filter((F.col("rec") == SLICE) & (F.col("batch") == b))
    is_sale, has = F.col("rec") == SALE, lambda bit: F.col("nulls").bitwiseAND(bit) == 0
    return (
        spark.read.schema(OUT).parquet(f"{root}/out")
        .filter(F.col("rec") != SLICE)
        .select(
            F.when(is_sale, "sale").otherwise("late").alias("rec"), F.when(F.col("id_nulls").bitwiseAND(NO_ID) == 0, F.col("id")).alias("id"), "batch", F.when(is_sale, F.col("n_held")).alias("n_held"),
            F.when(is_sale & has(NO_ID), F.col("change_id")).alias("change_id"), F.when(is_sale & has(NO_CENTS), F.col("cents")).alias("balance_cents"), F.when(is_sale, F.col("op")).alias("op"),
        )
    )


def enrich_sales(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """The shop's sales of January to May 2024, in ten batches."""
    return enrich(sales, changes, 10, 19723, 152)
