"""An inverted list index over vectors, and block-wise nearest neighbours with or without it.

``build`` fits centroids on a bounded sample, files every row under its nearest centroid (a table
partitioned by list) and measures, on sampled rows against all rows, in how many of a query's
nearest lists its true neighbours lie. A search reads the files of the lists it probes and scores
their rows exactly; probing all lists is exact. Vectors are compared by cosine: rows without a
vector, of another length or of zeros are in no result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ravine.functions import vector
from ravine.sources.shared import materialize

#: Rows and queries that meet in one task; queries of these that are multiplied at once, entries of a
#: product at most.
ROWS, QUERIES = 8192, 2048
AT_ONCE, ENTRIES = 128, 1 << 20
#: Rows on which centroids are fitted, at most; queries on which recall is measured, at most.
SAMPLE, TRIALS = 32768, 256
#: Lists at most: the centroids go to every task.
LISTS = 4096
ROUNDS = 8
#: The share of true neighbours that the default number of probes finds in the measurement.
TARGET = 0.95
#: Neighbours of a query in the measurement.
DEPTH = 10


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows; those of another length than ``width`` (default: the longest), or null: zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(flat) and not flat.null_count:  # without Python's numbers where all are of one length
        sizes = np.diff(flat.offsets.to_numpy())
        if (sizes == (sizes[0] if width is None else width)).all() and not flat.flatten().null_count:
            return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), int(sizes[0]))
    vectors = [np.asarray(v, np.float64) if v is not None else np.zeros(0) for v in column.to_pylist()]
    width = max((len(v) for v in vectors), default=0) if width is None else width
    return np.array([v if len(v) == width else np.zeros(width) for v in vectors]).reshape(len(vectors), width)


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _best(k: int):
    """Of a block of rows and a block of queries, the k nearest rows of each query."""

    def near(rows: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
        out: list[pa.Table] = [schema.empty_table()]
        if rows.num_rows and queries.num_rows:
            q = matrix(queries.column("embedding"))
            x = matrix(rows.column("embedding"), q.shape[1])
            ids, asked = rows.column("id").to_numpy(), queries.column("query_id").to_numpy()
            norm = np.sqrt((x * x).sum(axis=1))
            x, ids, norm = x[norm > 0], ids[norm > 0], norm[norm > 0]
            units, some = _units(q), np.abs(q).sum(axis=1) > 0
            units, asked = units[some], asked[some]
            most = min(k, len(x))
            for at in range(0, len(units) if most else 0, AT_ONCE):
                found = units[at : at + AT_ONCE] @ x.T
                found /= norm
                np.round(found, 6, out=found)
                found[np.isnan(found)] = -np.inf  # of infinite entries: behind all others
                least = np.partition(found, len(x) - most, axis=1)[:, len(x) - most]  # the k-th best of each query
                row, col = np.nonzero(found >= least[:, None])  # with its ties
                score = found[row, col]
                score[np.isneginf(score)] = np.nan
                order = np.lexsort((ids[col], -score, row))
                place = np.arange(len(row)) - np.searchsorted(row, row)  # rows are in order before and after
                order = order[place < most]
                out.append(pa.table([asked[at : at + AT_ONCE][row[order]], ids[col[order]], score[order]], schema=schema))
        return pa.concat_tables(out)

    return near


def _split(df: DataFrame, sizes: DataFrame, id_: str, each: int, own: str, other: str) -> DataFrame:
    """Rows dealt into blocks of about ``each`` within their list, once for every block of the other side.

    ``sizes`` has a row for each list (at most ``LISTS``), with the rows of either side."""
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size).cast("int"), F.lit(1))
    mine, theirs = (blocks("n_rows", ROWS), blocks("n_queries", each)) if own == "row_block" else (blocks("n_queries", each), blocks("n_rows", ROWS))
    dealt = df.join(F.broadcast(sizes), "list").withColumn(own, F.pmod(F.xxhash64(id_), mine).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), theirs - 1))).drop("n_rows", "n_queries")


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = QUERIES) -> DataFrame:
    """(query_id, id, similarity, rank): the k best rows (list, id, embedding) of every query, among the
    lists under which the query (list, query_id, embedding) stands.

    Both sides are dealt into blocks; each pair of blocks of a list is one group and one product, of
    which only k rows a query go on. Neither a block nor a list comes to the driver.
    """
    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))  # apart from the rows, if both are of one table
    n = queries.groupBy("list").agg(F.count("*").alias("n_queries")).join(rows.groupBy("list").agg(F.count("*").alias("n_rows")), "list")
    keys = ["list", "row_block", "query_block"]
    left, right = _split(rows, n, "id", block, "row_block", "query_block"), _split(queries, n, "query_id", block, "query_block", "row_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), "query_id bigint, id bigint, similarity double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))).filter(F.col("rank") <= k)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Each row once for each of its ``most`` nearest lists, nearest first."""
    step = max(1, ENTRIES // max(len(centroids), most * centroids.shape[1]))  # rows at once: of the product, and of what comes out
    for b in _slices(batches, step):
        x = _units(matrix(b.column(1), centroids.shape[1]))
        lists = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :most]
        at = np.repeat(np.arange(b.num_rows), lists.shape[1])
        yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(lists.ravel().astype(np.int32)), pa.array(np.tile(np.arange(lists.shape[1], dtype=np.int32), b.num_rows))], [*b.schema.names, "list", "place"])


def assign(df: DataFrame, centroids: np.ndarray, most: int = 1) -> DataFrame:
    """(id, embedding, list, place): rows under their nearest lists; ``place`` counts from 0."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(lambda it: _assigned(it, centroids, most), f"{kinds}, list int, place int")


def fit(sample: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors (id, embedding): rows at hash order start, then tasks add up the units
    nearest to each. The sample is bounded, so are the sums (one vector a list)."""
    first = sample.orderBy(F.xxhash64("id"), "id").limit(lists).toArrow()
    centroids = _units(matrix(first.column("embedding")))
    width = centroids.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), width))
        step = max(1, ENTRIES // len(centroids))
        for b in _slices(batches, step):
            x = _units(matrix(b.column(1), width))
            np.add.at(sums, (x @ centroids.T).argmax(axis=1), x)
        some = np.flatnonzero(np.abs(sums).sum(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(sums[some]))], ["list", "s"])

    for _ in range(rounds):
        new = np.zeros_like(centroids)
        for r in sample.mapInArrow(partial, "list int, s array<double>").collect():  # no more vectors than the sample has
            new[r["list"]] += r["s"]
        centroids = np.where(np.abs(new).sum(axis=1, keepdims=True) > 0, _units(new), centroids)
    return centroids


@dataclass
class VectorIndex:
    """An index on disk: ``rows`` by list, centroids, and the recall measured for 1, 2, ... probes."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    recall: list[float]
    probes: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema("id bigint, embedding array<float>, list int").parquet(f"{self.path}/rows")

    def lists(self, query: list[float], probes: int | None = None) -> list[int]:
        near = self.centroids @ _units(np.array([query], np.float64))[0]
        return np.argsort(-near, kind="stable")[: probes or self.probes].tolist()

    def search(self, query: list[float], k: int = 10, threshold: float = -2.0, probes: int | None = None) -> DataFrame:
        """The k nearest rows (id, similarity) above a threshold, from the files of the probed lists."""
        some = self.rows.filter(F.col("list").isin(self.lists(query, probes)))
        scored = some.select("id", F.round(vector.cosine_to(F.col("embedding"), query), 6).alias("similarity"))
        return scored.orderBy(F.col("similarity").desc_nulls_last(), "id").limit(k).filter(F.col("similarity") > threshold)

    def batch(self, queries: DataFrame, k: int = 3, probes: int | None = None) -> DataFrame:
        """The k nearest rows of every query (query_id, embedding)."""
        asked = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
        return nearest(self.rows, assign(asked, self.centroids, probes or self.probes).select("query_id", "embedding", "list"), k)

    def exact(self, query: list[float], k: int = 10, threshold: float = -2.0) -> DataFrame:
        return self.search(query, k, threshold, len(self.centroids))


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).filter("embedding IS NOT NULL")


def _some(vectors: DataFrame, n: int, total: int) -> DataFrame:
    """About n rows (at most twice as many), chosen by a hash of the id."""
    share = F.lit(1.0) if total <= n else F.lit(n / total)
    picked: Column = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < share * (1 << 30)
    return vectors.filter(picked).limit(2 * n)


def build(vectors: DataFrame, path: str, lists: int | None = None, target: float = TARGET, sample: int = SAMPLE) -> VectorIndex:
    """Index every row (id, embedding) below ``path``.

    ``lists``: the root of the number of rows, unless given; ``LISTS`` at most. Lists are gathered
    into files by a rebalancing shuffle, which splits large ones, so a hot vector is not one task.
    """
    spark, rows = vectors.sparkSession, _usable(vectors)
    total = rows.count()
    lists = max(1, min(lists or int(total**0.5), LISTS, total))
    fitted = materialize(_some(rows, sample, total), "vector-sample")
    centroids = fit(fitted, lists)
    placed = assign(rows, centroids).drop("place")
    placed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/rows")
    stored = VectorIndex(spark, path, centroids, [], lists)
    trials = _some(fitted, TRIALS, fitted.count()).select(F.col("id").alias("query_id"), "embedding")
    everywhere = lambda df: df.withColumn("list", F.lit(0))
    truth = nearest(everywhere(stored.rows.drop("list")), everywhere(trials), DEPTH).select("query_id", "id")
    where = assign(trials, centroids, len(centroids)).select("query_id", "list", "place")
    hits = truth.join(stored.rows.select("id", "list"), "id").join(where, ["query_id", "list"]).groupBy("place").count().collect()  # a row a list
    each = np.bincount([r["place"] for r in hits], [r["count"] for r in hits], minlength=len(centroids)) if hits else np.ones(len(centroids))
    recall = np.cumsum(each) / each.sum()
    probes = int(np.searchsorted(recall, target - 1e-12) + 1)
    out = VectorIndex(spark, path, centroids, [round(float(r), 4) for r in recall], min(probes, lists))
    rows_ = [(json.dumps({"recall": out.recall, "probes": out.probes}), [c.tolist() for c in centroids])]
    spark.createDataFrame(rows_, "about string, centroids array<array<double>>").write.parquet(f"{path}/about")
    return out


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build`` has written."""
    r = spark.read.parquet(f"{path}/about").first()
    about = json.loads(r["about"])
    return VectorIndex(spark, path, np.array(r["centroids"]), about["recall"], about["probes"])
