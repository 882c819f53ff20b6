"""Repeated windows of fixed length: what the two substring deduplications share.

Every window of ``length`` tokens has one anchor: of the ``gram``-token strings in it, the one with
the smallest hash, leftmost. Neighbouring windows with the same anchor form a segment. Equal
windows have equal anchors at equal offsets, so windows need comparing only between segments that
share an anchor's gram, and equal segments are equal window by window. So a corpus becomes about
two segments per window length, of which only those with a repeated gram are looked at again.

Grams that a sample shows to be common come last in the order of anchors. A window in which only a
part is common, such as a frequent line, then has its anchor outside that part, and the windows
that are left to a common gram are common as a whole: they make few different segments, however
many documents hold them. The order is fixed before the scan, so it never changes a result.

Hashes are polynomials over random 64-bit codes, modulo 2 ** 64, found for any substring from one
running sum. Strings such as Thue and Morse's collide modulo any power of two, so where a hash stands
for equality a second polynomial, modulo a prime, is mixed in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.llm.common import materialize, row_key

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Tokens that are worked on at once.
PIECE = 1 << 20
#: A gram with at least this share of the segments of a sample of so many documents is common; how
#: often the sample is looked at, at most.
COMMON_SHARE, COMMON_DOCS, ROUNDS = 20_000, 20_000, 4


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


#: A code for each byte value.
BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D))

_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, _U), np.empty(0, _U))


def _room(n: int) -> int:
    """Powers are kept for n and somewhat more, so that few are worked out anew."""
    return -(-(n + 1) // (1 << 18)) << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i up to n at least."""
    global _powers
    if len(_powers[0]) > n:
        return _powers
    made = []
    for base in (BASE, BASE_INVERSE):
        p = np.ones(_room(n), _U)
        p[1:] = _U(base)
        made.append(np.multiply.accumulate(p, out=p))
    if len(made[0]) <= 4 * PIECE:
        _powers = tuple(made)
    return tuple(made)


#: The second polynomial's modulus and base.
PRIME, PRIME_BASE = (1 << 31) - 1, 0x5DEECE66
_prime_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint32), np.empty(0, np.uint32))


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME_BASE ** i and PRIME_BASE ** -i modulo PRIME for i up to n at least."""
    global _prime_powers
    if len(_prime_powers[0]) > n:
        return _prime_powers
    made = []
    for base in (PRIME_BASE, pow(PRIME_BASE, -1, PRIME)):
        p = np.ones(_room(n), np.uint32)
        k = 1
        while k < len(p):  # twice as many each time
            more = p[: min(k, len(p) - k)]
            p[k : 2 * k] = more.astype(_U) * _U(pow(base, k, PRIME)) % _U(PRIME)
            k *= 2
        made.append(p)
    if len(made[0]) <= 4 * PIECE:
        _prime_powers = tuple(made)
    return tuple(made)


class Sums:
    """Hashes of substrings of an array of codes; ``exact``: fit to stand for equality."""

    def __init__(self, codes: np.ndarray, exact: bool = False):
        self.up, down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, _U)
        np.cumsum(codes * down[: len(codes)], out=self.sums[1:])
        self.second = None
        if exact:
            self.second_up, down = prime_powers(len(codes) + 1)
            self.second = np.zeros(len(codes) + 1, _U)
            terms = self.second[1:]
            np.right_shift(codes, _U(33), out=terms)
            terms *= down[: len(codes)]
            terms %= _U(PRIME)
            np.cumsum(terms, out=terms)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.sums[end] - self.sums[start]) * self.up[start]
        if self.second is not None:
            out = mix(out) + (self.second[end] - self.second[start]) % _U(PRIME) * self.second_up[start].astype(_U) % _U(PRIME) * _U(0xC2B2AE3D27D4EB4F)
        return mix(out)

    def each(self, n: int) -> np.ndarray:
        """The hash of every substring of n codes."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.up[: len(self.sums) - n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


class Common:
    """The common grams, COMMON_SHARE of them at most: which of an array's hashes are among them."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(np.asarray(grams, _U))
        self.some = np.zeros(1 << 20, bool)  # by leading bits, which tell most hashes apart
        self.some[self.grams >> _U(44)] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.empty(0, np.int64)
        at = np.flatnonzero(self.some[hashes >> _U(44)])
        near = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        return at[self.grams[near] == hashes[at]]


def anchors(hashes: np.ndarray, width: int, last: np.ndarray) -> np.ndarray:
    """The place of the least of every ``width`` neighbouring hashes; those at ``last`` come last."""
    low = _U((1 << 24) - 1)
    order = (hashes >> _U(1)) & ~low
    order[last] |= _U(1 << 63)
    return (sliding_min(order | np.arange(len(hashes), dtype=_U), width) & low).astype(np.int64)


def segments(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: np.ndarray, length: int, gram: int, reach: int, common: Common):
    """The segments of the texts codes[starts[i]:ends[i]], of which the first windows[i] windows count.

    In order and not overlapping. Returns text index, first window, number of windows, anchor, gram
    hash, and the hash of the segment with what follows it, up to ``reach`` tokens from its last
    window's start or the end of the text.
    """
    if len(codes) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    sums = Sums(codes, exact=True)
    hashes = sums.each(gram)
    at = anchors(hashes, length - gram + 1, common.among(hashes))
    edges = np.zeros(len(at) + 1, np.int32)
    some = windows > 0
    np.add.at(edges, starts[some], 1)
    np.add.at(edges, starts[some] + windows[some], -1)
    ok = np.cumsum(edges[:-1]) > 0
    change = np.empty(len(ok), bool)
    change[0] = True
    np.not_equal(at[1:], at[:-1], out=change[1:])
    change[1:] |= ok[1:] != ok[:-1]
    # windows of adjoining texts never touch: a text's last length - 1 places begin no window
    bounds = np.append(np.flatnonzero(change), len(ok))
    first, n = bounds[:-1], np.diff(bounds)
    first, n = first[ok[first]], n[ok[first]]
    which = np.searchsorted(starts, first, side="right") - 1
    anchor = at[first]
    prints = sums(first, np.minimum(first + n - 1 + reach, ends[which])) ^ mix((n << 20 | anchor - first).astype(_U))
    return which, first, n, anchor, hashes[anchor], prints


def pieces(lengths: list[int], overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of (text, from, to) with PIECE tokens or so; long texts are cut, with an overlap."""
    batch, held = [], 0
    for i, n in enumerate(lengths):
        at = 0
        while True:
            to = min(n, at + PIECE + overlap)
            if held and held + to - at > PIECE:
                yield batch
                batch, held = [], 0
            batch.append((i, at, to))
            held += to - at
            if to == n:
                break
            at = to - overlap
    if batch:
        yield batch


def texts(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each text (null: none), without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not large and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, large = column.cast(pa.large_binary()), True
    _, offsets, data = column.buffers()
    if offsets is None:
        return [np.empty(0, np.uint8)] * len(column)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [raw[a:b] if v else raw[:0] for a, b, v in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist())]


def byte_codes(text: np.ndarray) -> np.ndarray:
    return BYTE_CODES[text]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_codes(text: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word of a text."""
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        while to < len(text) and not _SPACE[text[to]]:  # not through a word
            more = np.flatnonzero(_SPACE[text[to : to + PIECE]])
            to += int(more[0]) if len(more) else len(text[to : to + PIECE])
        part = text[at:to]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~_SPACE[part]
        turn = np.diff(inside)
        out.append(Sums(BYTE_CODES[part], exact=True)(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)))
        at = to
    return np.concatenate(out) if out else np.empty(0, _U)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def finder(code: Callable, length: int, gram: int, reach: int, common: Common):
    """A scan of rows (did, rk, text): (did, rk, gram, fp, at) of every segment.

    at: how often the segment comes in a row (eleven bits), as in text that repeats a few words; the
    first window (31 bits); whether the gram is common (a bit); the number of windows (ten bits);
    the anchor's offset from the first (ten bits).
    """

    def _scan(rows, raw, did, rk):
        coded = {i: raw[i] if code is byte_codes else code(raw[i]) for i in rows}
        order = list(coded)
        sizes = [len(coded[i]) for i in order]
        for batch in pieces(sizes, reach - 1):
            joined = np.concatenate([coded[order[i]][a:z] for i, a, z in batch])
            if code is byte_codes:
                joined = byte_codes(joined)
            ends = np.cumsum([z - a for _, a, z in batch])
            starts = np.append(0, ends[:-1])
            # a piece that its text goes on after leaves the windows without full reach to the next
            windows = np.array([z - a - (length if z == sizes[i] else reach) + 1 for i, a, z in batch])
            which, first, n, anchor, grams, prints = segments(joined, starts, ends, windows, length, gram, reach, common)
            if not len(first):
                continue
            offset = np.array([a for _, a, _ in batch]) - starts
            new = np.ones(len(first), bool)
            new[1:] = (which[1:] != which[:-1]) | (prints[1:] != prints[:-1]) | (grams[1:] != grams[:-1]) | (first[1:] != first[:-1] + n[:-1])
            new |= (np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))) % 2047 == 0
            head = np.flatnonzero(new)
            times = np.diff(np.append(head, len(new)))
            which, first, n, anchor, grams, prints = (x[head] for x in (which, first, n, anchor, grams, prints))
            at = times << 52 | (first + offset[which]) << 21 | n << 10 | anchor - first
            at[common.among(grams)] |= 1 << 20
            row = np.array([order[i] for i, _, _ in batch])[which]
            yield pa.RecordBatch.from_arrays([pa.array(did[row]), pa.array(rk[row]), _signed(grams), _signed(prints), pa.array(at)], names=["did", "rk", "gram", "fp", "at"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, rk = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            raw, at = texts(b.column(2)), 0
            while at < len(raw):  # so many rows at once that their codes stay small
                to, held = at, 0
                while to < len(raw) and (to == at or held + len(raw[to]) <= 4 * PIECE):
                    held += len(raw[to])
                    to += 1
                yield from _scan(range(at, to), raw, did, rk)
                at = to

    return scan


SEGMENT = "did bigint, rk bigint, gram bigint, fp bigint, at bigint"


def times() -> Column:
    return F.shiftright("at", 52)


def first_window() -> Column:
    return F.shiftright("at", 21).bitwiseAND(F.lit((1 << 31) - 1))


def n_windows() -> Column:
    return F.shiftright("at", 10).bitwiseAND(F.lit(1023))


def is_common() -> Column:
    return F.col("at").bitwiseAND(F.lit(1 << 20)) != 0


def place(at: int) -> tuple[int, int, int]:
    """First window, number of windows, the anchor's offset."""
    return at >> 21 & (1 << 31) - 1, at >> 10 & 1023, at & 1023


def placed(found: DataFrame, size: Column | int, *more: str) -> DataFrame:
    """Segments joined with intervals of their windows (i, windows): (did, rk, a, b, more), the
    tokens in windows of ``size``. Segments in a row are one interval if all their windows count."""
    whole = (F.col("i") == 0) & (F.col("windows") == n_windows())
    copies = F.when(whole | (times() == 1), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), times() - 1))
    a = first_window() + F.col("copy") * n_windows() + F.col("i")
    rest = F.when(whole, (times() - 1) * n_windows()).otherwise(0)
    return found.withColumn("copy", F.explode(copies)).select("did", "rk", a.alias("a"), (a + F.col("windows") - 1 + size + rest).cast("long").alias("b"), *more)


def keyed(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """(did, rk, text), with ``name`` also the key itself: null keys count as the largest did; did
    and rk together tell rows apart."""
    own = F.col(key).cast("long")
    out = df.select(own.alias(name or "__key"), F.coalesce(own, F.lit((1 << 63) - 1)).alias("did"), row_key(key, "text").alias("rk"), "text")
    return out if name else out.drop("__key")


def _frequent(code: Callable, gram: int):
    """Rows (did, rk, text) to (gram, n): the more frequent grams of each batch of tokens, and under
    gram null the number of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = [code(t) for t in texts(b.column(2))]
            for batch in pieces([len(c) for c in coded], gram - 1):
                hashes = [Sums(coded[i][a:z]).each(gram) for i, a, z in batch if z - a >= gram]
                if hashes:
                    found, n = np.unique(np.concatenate(hashes), return_counts=True)
                    many = n >= max(4, int(n.sum()) // (4 * COMMON_SHARE))
                    yield pa.RecordBatch.from_arrays([pa.array([*found[many].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[many].tolist(), int(n.sum())], pa.int64())], names=["gram", "n"])

    return count


def common_grams(rows: DataFrame, code: Callable, length: int, gram: int) -> Common:
    """Grams that have a COMMON_SHARE-th of a sample's tokens, or of its segments, or more.

    Where common grams come last others take their windows, so the sample is looked at again with
    those found, until a round finds no more.
    """
    n = rows.count()
    sample = materialize(rows.sample(min(1.0, COMMON_DOCS / max(n, 1)), seed=1), "sample")
    some = sample.filter(F.pmod(F.xxhash64("rk"), F.lit(4)) == 0) if n > COMMON_DOCS else sample
    counts = some.mapInArrow(_frequent(code, gram), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).filter((F.col("n") >= 20) | F.col("gram").isNull()).collect()
    total = max((r.n for r in counts if r.gram is None), default=0)
    often = [r.gram for r in counts if r.gram is not None and r.n >= total // COMMON_SHARE]  # COMMON_SHARE at most
    common = Common(np.array(often, np.int64).view(_U))
    for _ in range(ROUNDS):
        grams = sample.mapInArrow(finder(code, length, gram, length, common), SEGMENT).rollup("gram").agg(F.sum(times()).alias("n"), F.max(is_common()).alias("known"))
        rows_ = grams.filter((F.col("n") >= 20) & ~F.col("known") | F.col("gram").isNull()).collect()  # a twentieth of the sample's segments at most
        seen = max((r.n for r in rows_ if r.gram is None), default=0)
        found = [r.gram for r in rows_ if r.gram is not None and r.n >= seen // COMMON_SHARE]  # COMMON_SHARE at most
        if not found:
            break
        common = Common(np.concatenate([common.grams, np.array(found, np.int64).view(_U)]))
    return common


def repeated(rows: DataFrame, code: Callable, length: int, gram: int, reach: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The segments whose gram occurs more than once (or is common), and each different one of
    these: gram, fp, n, the least and the largest did (low, high), one place (did, rk, at).

    Both are tables in the shared folder. Segments of common grams, which are known, are dealt over
    all tasks and not counted by gram; equal segments are counted before they are shuffled.
    """
    common = common_grams(rows, code, length, gram)
    found = rows.mapInArrow(finder(code, length, gram, reach or length, common), SEGMENT)
    share = F.when(is_common(), F.xxhash64("rk", "at")).otherwise(F.lit(0))
    of_gram = Window.partitionBy("gram", "share")
    found = found.withColumn("share", share).withColumn("n", F.sum(times()).over(of_gram))
    found = materialize(found.filter((F.col("n") > 1) | is_common()).select("did", "rk", "gram", "fp", "at"), "segments")
    # the three firsts are of one row: all see the same rows in the same order
    one = [F.first(c).alias(c) for c in ("did", "rk", "at")]
    return found, materialize(found.groupBy("gram", "fp").agg(F.sum(times()).alias("n"), F.min("did").alias("low"), F.max("did").alias("high"), *one), "distinct")


def with_texts(rows: DataFrame, places: DataFrame, fields: list[str]) -> DataFrame:
    """Join places (did, rk and ``fields``) to their texts: (text, places) a row for each text.

    A text's places are fewer than its tokens, so their list is no longer than the text.
    """
    lists = places.groupBy("did", "rk").agg(F.collect_list(F.struct(*fields)).alias("places"))
    return rows.join(lists, ["did", "rk"]).select("text", "places")


def intervals(spans: DataFrame, *more: str) -> DataFrame:
    """(did, rk, spans): all intervals (a, b and ``more``) of a row, fewer than its tokens."""
    return spans.groupBy("did", "rk").agg(F.collect_list(F.struct("a", "b", *more)).alias("spans"))


def union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of intervals that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
