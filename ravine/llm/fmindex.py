"""Substring deduplication of word windows by an FM-index for each shard.

A word goes if a window of ``length`` words that covers it also starts in a row with a smaller
key. Windows are folded into segments (see ``spans``); one whose gram occurs once repeats nowhere.
Each different segment of the rest is dealt to a shard by gram; a shard indexes the words of its
segments — Burrows-Wheeler transform, bits of a wavelet matrix with rank counts for every 64 — and
streams them through backward search: the search of a window is extended word by word to the left
up to the threshold, or until its interval holds only the window itself, which gives the matching
statistics at that depth and, from the intervals, the least key in which each window starts. Bit
vectors are packed, not entropy-coded.

A gram with so many different segments that they would not fit a shard is split: its windows are
dealt by the next grams around it too (the second smallest, third smallest and so on that a window
has), until each share fits. Equal windows have equal grams, so they stay together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ravine.llm import spans as S
from ravine.llm.common import materialize, partitions

LENGTH, GRAM = 13, 5
#: Words that a shard indexes at most (the segments of a share stay together).
SHARD = 1 << 20
#: Different segments of a gram, beyond which it is split.
WIDE = 20_000

_U = np.uint64


class Bits:
    """A bit vector with rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(_U)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        mask = (_U(1) << (i & 63).astype(_U)) - _U(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """A sequence of small numbers with rank, one bit vector for each bit of a number."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        # below the last level values stand by their reversed bits: where each symbol's run begins
        reverse = np.zeros(1, np.int64)
        for _ in range(bits):
            reverse = np.concatenate([2 * reverse, 2 * reverse + 1])
        counts = np.bincount(values, minlength=1 << bits)[reverse]
        self.start = np.empty(1 << bits, np.int64)
        self.start[reverse] = np.cumsum(counts) - counts

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for n, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.rank(i)
            i = np.where((symbol >> (len(self.levels) - 1 - n)) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """For each pair, how often the symbol is among the first i values."""
        return self._descend(symbol, i.astype(np.int64)) - self.start[symbol]


class FMIndex:
    """An index of texts (arrays of numbers from 1) for patterns of up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, depth: int):
        """``symbols``: the texts, each ended by a 0."""
        n = len(symbols)
        self.alphabet = int(symbols.max()) + 1 if n else 1
        bits = max(1, (self.alphabet - 1).bit_length())
        span = max(1, min(62 // bits, depth + 1, n))  # symbols that one number holds
        key = np.zeros(n, np.int64)
        for i in range(span):
            key[: n - i] |= symbols[i:].astype(np.int64) << bits * (span - 1 - i)
        order = np.argsort(key)
        while span < depth + 1:  # prefix doubling, as deep as patterns reach
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(True, np.diff(key[order]) != 0)[:n])
            key = rank * (n + 1)
            key[:-span] += rank[span:] if span < n else 0
            order, span = np.argsort(key), span * 2
        self.order = order
        self.size = n
        self.counts = np.bincount(symbols, minlength=self.alphabet)
        self.first = np.cumsum(self.counts) - self.counts
        self.bwt = WaveletMatrix(symbols[order - 1], bits)

    def search(self, symbols: np.ndarray, ends: np.ndarray, depth: int, indexed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each end (exclusive): matched length up to depth, and its interval.

        Symbol 0 ends a match. ``indexed``: the patterns are parts of the indexed texts, so an
        interval of one suffix is the pattern's own, and its search stops there.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        length, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for step in range(1, depth + 1):
            at = ends[live] - step
            live = live[(at >= 0) & (symbols[np.maximum(at, 0)] != 0)]
            if not len(live):
                break
            c = symbols[ends[live] - step]
            if step == 1:
                a = self.first[c]
                b = a + self.counts[c]
            else:
                a = self.first[c] + self.bwt.rank(c, low[live])
                b = self.first[c] + self.bwt.rank(c, high[live])
            some = b > a
            live, a, b = live[some], a[some], b[some]
            low[live], high[live], length[live] = a, b, step
            if indexed:
                live = live[b - a > 1]
        return length, low, high


def least_keys(words: list[np.ndarray], keys: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the least key of a text that has each of its windows."""
    sizes = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]), _U)
    for w, e in zip(words, ends.tolist()):
        flat[e - 1 - len(w) : e - 1] = w
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    symbols = np.zeros(len(flat), np.int64)
    symbols[inside] = np.unique(flat[inside], return_inverse=True)[1] + 1
    index = FMIndex(symbols, length)
    key_of = np.repeat(keys, sizes)[index.order]
    first = ends - sizes
    counts = np.maximum(sizes - length, 0)
    total = int(counts.sum())
    stop = np.repeat(first + length - (np.cumsum(counts) - counts), counts) + np.arange(total)
    matched, low, high = index.search(symbols, stop, length, indexed=True)
    least = np.repeat(keys, counts)  # of a window that is nowhere else
    # intervals of one depth don't overlap
    full = np.flatnonzero(matched == length)
    lows, at, inverse = np.unique(low[full], return_index=True, return_inverse=True)
    highs = high[full][at]
    if len(lows):
        cuts = np.stack([lows, np.minimum(highs, index.size)], axis=1).ravel()
        padded = np.append(key_of, np.iinfo(np.int64).max)
        least[full] = np.minimum.reduceat(padded, cuts)[::2][inverse]
    return np.split(least, np.cumsum(counts)[:-1])


def _binary(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "words" else pa.int64()) for c, n in zip(zip(*rows), names)], names=names)


def _words_of(length: int):
    """(text, places) to (share, gram, fp, skip, low, wide, words): the words of each place's segment."""
    names = _UNIT_NAMES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for text, places in zip(S.texts(b.column(0)), b.column(1)):
                codes = S.word_codes(text)
                for p in places.as_py():
                    first, n, _ = S.place(p["at"])
                    rows.append((p["gram"], p["gram"], p["fp"], 0, p["low"], p["wide"], codes[first : first + n - 1 + length].tobytes()))
                if len(rows) > 20_000:
                    yield _binary(rows, names)
                    rows = []
        if rows:
            yield _binary(rows, names)

    return cut


#: share: what a unit is dealt by; gram and fp: its segment; skip: its first window there.
_UNIT = "share bigint, gram bigint, fp bigint, skip bigint, low bigint, wide bigint, words binary"
_UNIT_NAMES = [f.split()[0] for f in _UNIT.split(", ")]


def shares(words: np.ndarray, length: int, gram: int, depth: int) -> np.ndarray:
    """For each window, a hash of the ``depth`` smallest different gram hashes that it has."""
    grams = np.sort(np.lib.stride_tricks.sliding_window_view(S.Sums(words).each(gram), length - gram + 1), axis=1)
    new = np.ones(grams.shape, bool)
    new[:, 1:] = grams[:, 1:] != grams[:, :-1]
    taken = new & (np.cumsum(new, axis=1) <= depth)
    return S.mix(np.where(taken, S.mix(grams), np.uint64(0)).sum(axis=1, dtype=_U) + np.uint64(depth))


def _split(length: int, gram: int, depth: int):
    """Units to smaller ones: neighbouring windows of one share each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            ints = zip(*(b.column(c).to_pylist() for c in ("gram", "fp", "skip", "low")))
            for (g, fp, skip, low), packed in zip(ints, b.column("words")):
                words = np.frombuffer(packed.as_py(), _U)
                of = shares(words, length, gram, depth).view(np.int64)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
                for i, n in zip(starts.tolist(), np.diff(np.append(starts, len(of))).tolist()):
                    rows.append((int(of[i]), g, fp, skip + i, low, 0, words[i : i + n - 1 + length].tobytes()))
            if rows:
                yield _binary(rows, _UNIT_NAMES)

    return cut


def _shards(length: int):
    """Units sorted by share to (share, unit, whole, i, windows, least): runs of windows with one least key."""

    def solve(rows):
        of, units, whole, lows, words = zip(*rows)
        out = ([], [], [], [], [], [])
        for s, u, w, least in zip(of, units, whole, least_keys([np.frombuffer(w, _U) for w in words], np.array(lows, np.int64), length)):
            turn = np.flatnonzero(np.diff(least)) + 1
            starts = np.concatenate([[0], turn])
            for i, n in zip(starts.tolist(), np.diff(np.append(starts, len(least))).tolist()):
                for o, v in zip(out, (s, u, w, i, n, int(least[i]))):
                    o.append(v)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["share", "unit", "whole", "i", "windows", "least"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("share", "unit", "whole", "low", "words"))):
                if n > SHARD and row[0] != held[-1][0]:
                    yield solve(held)
                    held, n = [], 0
                held.append(row)
                n += len(row[4]) // 8
        if held:
            yield solve(held)

    return index


def _narrow(wide: DataFrame, length: int, gram: int) -> DataFrame | None:
    """Units of wide grams, split again and again until the shares have at most WIDE different ones
    each, or a window's grams are used up (then a share has hardly more than one window)."""
    out, depth = None, 2
    while depth <= length - gram + 1 and wide.limit(1).count():
        parts = materialize(wide.mapInArrow(_split(length, gram, depth), _UNIT), "split")
        each = parts.select("share", F.xxhash64("words").alias("unit")).distinct().groupBy("share").agg((F.count(F.lit(1)) > WIDE).cast("long").alias("wide"))
        parts = parts.drop("wide").join(each, "share").select(*_UNIT_NAMES)
        done = parts if depth == length - gram + 1 else parts.filter("wide = 0")
        out = done if out is None else out.unionByName(done)
        wide, depth = parts.filter("wide = 1"), depth + 1
    return out


def earlier(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(did, rk, a, b): intervals of words in windows that also start under a smaller did."""
    found, distinct = S.repeated(rows, S.word_codes, length, gram)
    wide = materialize(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > WIDE).select("gram"), "wide")
    if wide.limit(1).count():
        places = distinct.join(wide.withColumn("wide", F.lit(1).cast("long")), "gram", "left").fillna(0, ["wide"])
    else:
        places = distinct.withColumn("wide", F.lit(0).cast("long"))
    words = materialize(S.with_texts(rows, places, ["at", "gram", "fp", "low", "wide"]).mapInArrow(_words_of(length), _UNIT), "words")
    units = words.filter("wide = 0").select("share", F.col("fp").alias("unit"), "low", "words", F.lit(True).alias("whole"))
    parts = _narrow(words.filter("wide = 1"), length, gram)
    if parts is not None:  # equal ones of a share are indexed once
        parts = parts.withColumn("unit", F.xxhash64("words"))
        units = units.unionByName(parts.groupBy("share", "unit").agg(F.min("low").alias("low"), F.first("words").alias("words"), F.lit(False).alias("whole")))
    total = words.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0
    dealt = units.repartition(partitions(rows.sparkSession, total, 16 << 20), "share").sortWithinPartitions("share")
    least = materialize(dealt.mapInArrow(_shards(length), "share bigint, unit bigint, whole boolean, i bigint, windows bigint, least bigint"), "least-keys")
    known = least.filter("whole").select(F.col("share").alias("gram"), F.col("unit").alias("fp"), "i", "windows", "least")
    if parts is not None:
        of = parts.select("share", "unit", "gram", "fp", "skip").join(least.filter("not whole"), ["share", "unit"])
        known = known.unionByName(of.select("gram", "fp", (F.col("skip") + F.col("i")).alias("i"), "windows", "least"))
    return S.placed(found.join(known, ["gram", "fp"]).filter("did > least"), length)


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), run]
    for b in batches:
        rows = []
        for doc, text, spans in zip(b.column(0), S.texts(b.column(1)), b.column(2)):
            words, runs, at, kept = text.tobytes().split(), S.union(spans.as_py()), 0, []
            for x, y in runs:
                kept += words[at:x]
                at = y
            kept += words[at:]
            rows.append((doc.as_py(), len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"a": x, "b": y} for x, y in runs]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])


def dedup_words(df: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For each row: (doc_id, n_words, n_removed, kept_sha256, spans), spans in words.

    Windows never cross rows and are judged on the input. Null texts have no words. A null key
    counts as larger than any other; rows with equal keys don't remove each other's words. Very long
    texts are scanned in overlapping pieces; an empty table gives an empty one; columns other than
    the key and ``text`` are ignored, whatever their names.
    """
    rows = S.keyed(df, key)
    found = materialize(S.intervals(earlier(rows, length, gram)), "spans")
    joined = S.keyed(df, key, "doc_id").join(found, ["did", "rk"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_rest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<a:bigint,b:bigint>>")


def dedup_documents(documents: DataFrame) -> DataFrame:
    return dedup_words(documents).drop("spans")
