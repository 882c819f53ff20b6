"""A positional inverted index, the search grammar over it, and cover-density ranks.

``build`` files one row for each term and document, with the term's positions, by a hash of the term
and sorted by term, so a search reads its terms' rows and never a text. Phrases are met by shifting
positions. The rank looks at minimal covers: shortest stretches of a document that hold every
condition of an alternative; each adds ``WEIGHT`` over one plus the number of words in it that the
query doesn't ask for (Clarke, Cormack and Tudhope 2000, in the form that SQL full-text ranks have).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ravine.functions import grammar, rank, stemmer

BUCKETS = 64
#: Bytes of text that are indexed at once, about.
BYTES = 1 << 20
#: What a cover without other words adds.
WEIGHT = 0.1
_TOKEN = re.compile("[a-z0-9]+")
SCHEMA = "term string, id bigint, size int, positions array<int>"


def _plain(word: str) -> str:
    return word


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BYTES`` of text, a document at least."""
    sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // BYTES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [b.num_rows]])
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield b.slice(start, end - start)


def _postings(batches: Iterator[pa.RecordBatch], stem) -> Iterator[pa.RecordBatch]:
    """Terms, documents and positions of some texts at once: each different word is stemmed once, and
    words are sorted as numbers."""
    for part in (p for b in batches if b.num_rows for p in _parts(b)):
        known: dict[str, int] = {}
        codes = []
        for text in part.column(1):
            words = _TOKEN.findall((text.as_py() or "").lower())
            codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        sizes, terms = np.array([len(c) for c in codes]), {}
        of = np.array([terms.setdefault(stem(w), len(terms)) for w in known], np.int64)
        code, doc = of[np.concatenate(codes)], np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = doc * len(terms) + code
        order = np.argsort(key, kind="stable")  # positions stay in order
        begins = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)[: len(key)])
        first = order[begins]
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(key)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
        rows = [pa.array(list(terms), pa.string()).take(pa.array(code[first])), part.column(0).take(pa.array(doc[first])), pa.array(sizes[doc[first]].astype(np.int32)), lists]
        yield pa.RecordBatch.from_arrays(rows, ["term", "id", "size", "positions"])


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def positions(run: list[str]) -> Column:
    """Where a run of words begins, from ``at`` (a map from term to positions); empty where it doesn't."""
    of = lambda i, w: F.transform(F.coalesce(F.try_element_at("at", F.lit(w)), F.array().cast("array<int>")), lambda p: p - i)
    return reduce(F.array_intersect, [of(i, w) for i, w in enumerate(run)])


def cover_density(items: Column, n: int) -> Column:
    """The rank of a document from the positions of each of n items (an array of arrays).

    Going through all positions in order, a cover ends where its beginning, the earliest of the items'
    last positions, has moved on.
    """
    each = F.flatten(F.transform(items, lambda ps, i: F.transform(ps, lambda p: F.struct(p.alias("p"), i.alias("i")))))
    empty = F.struct(
        F.array_repeat(F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("k")), n).alias("last"), F.lit(-1).alias("begun"), F.lit(0).alias("k"), F.lit(0.0).alias("sum")
    )

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda v, i: F.when(i == x["i"], F.struct(x["p"].alias("p"), s["k"].alias("k"))).otherwise(v))
        first = lambda l: F.array_min(l)  # noqa: E731, E741
        others = F.greatest((x["p"] - first(last)["p"]) - (s["k"] - first(last)["k"]), F.lit(0))  # items may begin together
        fresh = first(last)["p"] > s["begun"]
        return F.struct(last.alias("last"), F.when(fresh, first(last)["p"]).otherwise(s["begun"]).alias("begun"), (s["k"] + 1).alias("k"), (s["sum"] + F.when(fresh, F.lit(WEIGHT) / (others + 1)).otherwise(F.lit(0.0))).alias("sum"))

    return F.aggregate(F.array_sort(each), empty, step, lambda s: s["sum"])


@dataclass
class TextIndex:
    """An index on disk; ``english``: words are stemmed by Porter2, else they stand as they are."""

    spark: SparkSession
    path: str
    english: bool
    buckets: int

    def stem(self, word: str) -> str:
        return stemmer.stem(word) if self.english else word

    def postings(self, terms: list[str]) -> DataFrame:
        """The rows of some terms: partitions by bucket, then row groups and pages by term."""
        rows = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.path}/postings")
        some = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), self.buckets)).collect()  # of the query's words
        return rows.filter(F.col("bucket").isin([r[0] for r in some]) & F.col("term").isin(terms)).drop("bucket")

    def matches(self, query: str) -> DataFrame:
        """(id, rank) of every document that meets a query of the search grammar.

        Negation takes documents of its alternative away; the ranks of alternatives that are met add up.
        A query without a condition, or with absent words only, meets nothing.
        """
        parsed = [[(absent, list(run)) for absent, run in dict.fromkeys((absent, tuple(run)) for absent, run in every)] for every in grammar.parse(query, self.stem)]
        parsed = [every for every in parsed if not all(absent for absent, _ in every)]
        terms = list(dict.fromkeys(w for every in parsed for _, run in every for w in run))
        if not terms:
            return self.spark.createDataFrame([], "id bigint, rank double")
        found = self.postings(terms).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))  # no more entries than the query has words
        score, met = F.lit(0.0), F.lit(False)
        for i, every in enumerate(parsed):
            items = [positions(run) for absent, run in every if not absent]
            found = found.withColumn(f"i{i}", F.array(*items))
            holds = F.forall(f"i{i}", lambda x: F.size(x) > 0) & reduce(lambda a, b: a & b, [F.size(positions(run)) == 0 for absent, run in every if absent], F.lit(True))
            score, met = score + F.when(holds, cover_density(F.col(f"i{i}"), len(items))).otherwise(0.0), met | holds
        return found.filter(met).select("id", score.alias("rank"))

    def search(self, query: str, k: int = 20, among: DataFrame | None = None, normalised: bool = True) -> DataFrame:
        """The k best documents (id, score); ``among``: only these (id). Normalised: r / (r + 1)."""
        found = self.matches(query)
        if among is not None:
            found = found.join(among.select("id").distinct(), "id", "left_semi")
        score = F.col("rank") / (F.col("rank") + 1) if normalised else F.col("rank")
        return found.select("id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)

    def bm25(self, words: list[str], k: int = 10) -> DataFrame:
        """The k best documents by BM25: the index has every count that it needs."""
        terms = list(dict.fromkeys(map(self.stem, words)))
        about = self.spark.read.parquet(f"{self.path}/about").first()
        rows = self.postings(terms).select("id", "term", "size", F.size("positions").alias("tf"))
        df = {r["term"]: r["count"] for r in rows.groupBy("term").count().collect()}  # of the query's words
        each = rows.groupBy("id").agg(F.first("size").alias("size"), *(F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)))
        score = rank.bm25({t: F.col(f"tf{i}") for i, t in enumerate(terms)}, F.col("size"), about["n"], df, about["mean"] or 1.0)
        return each.select("id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def build(docs: DataFrame, path: str, text: str = "text", english: bool = True, buckets: int = BUCKETS) -> TextIndex:
    """Index every document (id, text) below ``path``. A frequent term's rows go over several files."""
    spark, stem = docs.sparkSession, stemmer.stem if english else _plain
    rows = docs.select(F.col("id").cast("long").alias("id"), F.col(text).alias("text"))
    posted = rows.mapInArrow(lambda it: _postings(it, stem), SCHEMA).withColumn("bucket", _bucket(F.col("term"), buckets))
    posted.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    sizes = spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{path}/postings").agg(F.sum(F.size("positions").cast("long")).alias("words"))
    n = docs.agg(F.count("*").alias("n"))
    n.join(sizes).select("n", (F.coalesce("words", F.lit(0)) / F.greatest("n", F.lit(1))).alias("mean")).write.parquet(f"{path}/about")  # one row each
    return TextIndex(spark, path, english, buckets)
