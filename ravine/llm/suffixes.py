"""Suffix-array deduplication of byte strings.

A byte goes if a ``length``-byte string that covers it starts anywhere else too. Suffixes begin at
window starts and are compared to a depth of ``length`` bytes:

1. Windows are folded into segments (see ``spans``). A segment whose gram occurs once has no window
   that repeats and goes no further; equal segments are one, with their number as its weight.
2. Segments are range-partitioned by sampled splitters over the leading tokens of the suffix that
   begins at their gram: eight bytes each, then the bytes after the gram. A bucket has about
   ``BUCKET`` bytes, whatever a gram's share.
3. A bucket takes one suffix of every ``CELL`` neighbouring windows, at equal places in equal texts,
   and sorts them by multikey quicksort: by one token at a time, ties only. All windows of a cell
   share its suffix' first ``length - CELL + 1`` bytes; tied cells are told apart, window by window,
   by the bytes before and after these. Equal windows that weigh two or more repeat.
4. The grams at a bucket's ends may go on in the next one. What of their windows has no partner is
   compared across boundaries, by a hash of the window, summed up before the shuffle.

The same sort reports shorter passages: a byte is shared if a ``report``-byte string that covers it
starts in another row too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ravine.llm import spans as S
from ravine.llm.common import materialize, partitions

LENGTH, REPORT, GRAM, CELL = 400, 256, 64, 16
#: Bytes of text in a bucket.
BUCKET = 6 << 20
#: Kinds of a bucket's rows: intervals that repeat or are shared, windows to look for in other
#: buckets, and what a bucket has of each window there.
REMOVED, SHARED, OPEN, SUM = 0, 1, 2, 4

_U = np.uint64


def tokens(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number whose order is theirs; zeros follow the end."""
    padded = np.zeros(-(-len(data) // 8) * 8 + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(padded) - 8, _U)
    for k in range(8):
        out[k::8] = padded[k : k + len(out[k::8]) * 8].view(">u8")
    return out[: len(data) + 1]


def multikey_quicksort(tok: np.ndarray, at: np.ndarray, group: np.ndarray, begin: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes at ``at`` by group, then by their bytes from ``begin`` to ``depth``.

    Returns the order and, for each place in it, whether it ties with the one before. A token is
    compared only within ties, and ties are sorted only where one differs from its group's first.
    """
    order = np.argsort(group, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = group[order[1:]] == group[order[:-1]]
    steps = [*range(begin, depth - 7, 8)] if depth - begin >= 8 else []
    if not steps or steps[-1] != depth - 8:
        steps.append(max(depth - 8, 0))  # the last token overlaps the one before
    for k in range(0, len(steps), 4):
        tied = same.copy()
        tied[:-1] |= same[1:]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        head = ~same[place]
        rows = at[order[place]]
        first = rows[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
        other = np.zeros(len(place), bool)
        for d in steps[k : k + 4]:
            other |= tok[rows + d] != tok[first + d]
        number = np.cumsum(head) - 1
        odd = np.zeros(int(number[-1]) + 1, bool)
        odd[number[other]] = True
        place = place[odd[number]]
        for d in steps[k : k + 4]:
            if not len(place):
                break
            number, token = np.cumsum(~same[place]), tok[at[order[place]] + d]
            by = np.lexsort((token, number))
            order[place], token = order[place[by]], token[by]
            same[place[1:]] &= token[1:] == token[:-1]
            tied = same[place]
            tied[:-1] |= same[place[1:]] & (place[1:] == place[:-1] + 1)
            place = place[tied]
    return order, same


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of counts, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Bucket:
    """Segments of a bucket: their texts one after another, windows, anchors, weights and rows."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, windows: np.ndarray, offset: np.ndarray, key: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, cell: int):
        self.data, self.tok = data, tokens(np.concatenate([data, np.zeros(64, np.uint8)]))
        self.start, self.size, self.windows, self.offset, self.n, self.low, self.high, self.cell = start, size, windows, offset, n, low, high, cell
        lowest, top = (offset - windows + 1) // cell, offset // cell
        count = top - lowest + 1
        row = np.repeat(np.arange(len(start)), count)
        g = np.repeat(lowest, count) + _ranges(count)
        self.row, self.core = row, start[row] + offset[row] - cell * g
        self.lo, self.hi = offset[row] - np.minimum(cell * g + cell - 1, offset[row]), offset[row] - np.maximum(cell * g, offset[row] - windows[row] + 1)
        #: Cells of one gram and one distance from it.
        self.group = S.mix(key[row] + g.astype(_U)).view(np.int64)

    def repeats(self, length: int, kind: int, group: np.ndarray | None, begin: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Intervals (segment, first window, windows) of what repeats at ``length``, and each cell's class."""
        cell, depth = self.cell, length - self.cell + 1
        hi = np.minimum(self.hi, (self.size - length)[self.row])  # windows that the text is long enough for
        live = np.flatnonzero(hi >= self.lo)
        classes = -1 - np.arange(len(self.row))
        if not len(live):
            return [np.empty((3, 0), np.int64)], classes
        order, same = multikey_quicksort(self.tok, self.core[live], (self.group if group is None else group)[live], begin, depth)
        order = live[order]
        number = np.cumsum(~same) - 1
        classes[order] = number
        head = np.flatnonzero(~same)
        row, lo, hi = self.row[order], self.lo[order], hi[order]
        n, low, high = self.n[row], self.low[row], self.high[row]
        many = np.diff(np.append(head, len(order))) > 1
        out = [self._kept(row, lo, hi, kind, n, low, high, ~many[number])]
        # of cells that tie, those whole and alike repeat as they are; of the others each window is looked at
        core, x0 = self.core[order], self.start[row] + lo - self.core[order] + cell - 1
        odd = (x0 != 0) | (hi - lo != cell - 1)
        edges = core - cell + 1, core + depth
        for side in edges:
            side = np.maximum(side, 0)
            for d in (0, max(cell - 9, 0)):  # cell - 1 bytes, by one or two tokens
                token = self.tok[side + d]
                if cell <= 8:
                    token = token >> _U(8 * (9 - cell))
                odd |= token != token[head][number]
        bad = np.zeros(len(head), bool)
        bad[number[odd]] = True
        alike = many & ~bad
        weight, least, most = (f.reduceat(v, head)[number] for f, v in ((np.add, n), (np.minimum, low), (np.maximum, high)))
        out.append(self._kept(row, lo, hi, kind, weight, least, most, alike[number]))
        rest = np.flatnonzero((many & bad)[number])
        if len(rest):
            out.append(self._windows(row[rest], lo[rest], hi[rest], core[rest], number[rest], depth, kind))
        return out, classes

    @staticmethod
    def _kept(row, lo, hi, kind, weight, low, high, where):
        ok = where & ((weight >= 2) if kind == REMOVED else (low != high))
        return np.stack([row[ok], lo[ok], hi[ok] - lo[ok] + 1])

    def _windows(self, row, lo, hi, core, number, depth, kind):
        """As ``repeats``, for cells that tie but differ at their ends: sorted by the bytes there."""
        cell, count = self.cell, hi - lo + 1
        of = np.repeat(np.arange(len(row)), count)
        i = lo[of] + _ranges(count)
        begin = self.start[row[of]] + i
        before = core[of] - begin  # bytes before the core; cell - 1 - before follow it
        keys = np.zeros((2, len(of)), _U)
        for j in range(cell - 1):
            byte = self.data[np.where(j < before, begin + j, begin + j + depth)]
            keys[j >> 3] |= byte.astype(_U) << _U(56 - 8 * (j & 7))
        which = number[of] * cell + before
        by = np.lexsort((keys[1], keys[0], which))
        new = np.ones(len(by), bool)
        new[1:] = (which[by[1:]] != which[by[:-1]]) | (keys[:, by[1:]] != keys[:, by[:-1]]).any(axis=0)
        head, run = np.flatnonzero(new), np.cumsum(new) - 1
        owner = row[of[by]]
        weight, low, high = (f.reduceat(v[owner], head)[run] for f, v in ((np.add, self.n), (np.minimum, self.low), (np.maximum, self.high)))
        return self._kept(owner, i[by], i[by], kind, weight, low, high, np.ones(len(by), bool))


def runs(intervals: list[np.ndarray]) -> np.ndarray:
    """Intervals (segment, first window, windows), none overlapping, as maximal ones in order."""
    row, first, n = np.concatenate(intervals, axis=1)
    by = np.lexsort((first, row))
    row, first, n = row[by], first[by], n[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1] + n[:-1])
    head = np.flatnonzero(new)
    return np.stack([row[head], first[head], np.add.reduceat(n, head)]) if len(head) else np.stack([row, first, n])


_OUT = "kind int, gram bigint, fp bigint, i bigint, windows bigint, key bigint, weight bigint, low bigint, high bigint"
_OUT_NAMES = [f.split()[0] for f in _OUT.split(", ")]


def _rows(kind: int, gram, fp, i, windows, key, weight, low, high) -> pa.RecordBatch:
    n = max(np.size(x) for x in (gram, fp, i, windows, key, weight, low, high))
    cols = [np.full(n, kind, np.int32)] + [np.broadcast_to(np.asarray(x, np.int64), n) for x in (gram, fp, i, windows, key, weight, low, high)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=_OUT_NAMES)


def _edges(b: Bucket, rows: np.ndarray, gram: np.ndarray, fp: np.ndarray, length: int, kind: int, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For segments ``rows``: what the bucket has of each window, and the windows that found no partner."""
    codes = S.Sums(S.BYTE_CODES[np.concatenate([b.data[b.start[r] : b.start[r] + b.size[r]] for r in rows.tolist()])], exact=True)
    base = np.cumsum(b.size[rows]) - b.size[rows]
    count = np.maximum(np.minimum(b.windows[rows], b.size[rows] - length + 1), 0)
    of, i = np.repeat(np.arange(len(rows)), count), _ranges(count)
    if not len(of):
        return
    key = codes(base[of] + i, base[of] + i + length).view(np.int64)
    r = rows[of]
    by = np.lexsort((key, gram[r]))
    new = np.ones(len(by), bool)
    new[1:] = (key[by[1:]] != key[by[:-1]]) | (gram[r[by[1:]]] != gram[r[by[:-1]]])
    head = np.flatnonzero(new)
    weight, low, high = (f.reduceat(v[r[by]], head) for f, v in ((np.add, b.n), (np.minimum, b.low), (np.maximum, b.high)))
    yield _rows(SUM + kind, gram[r[by[head]]], 0, 0, 0, key[by[head]], weight, low, high)
    settled = np.zeros(len(of), bool)  # windows of the known intervals
    flat = np.full(len(b.start), -1)
    flat[rows] = np.cumsum(count) - count
    mine = known[:, flat[known[0]] >= 0] if known.shape[1] else known
    settled[np.repeat(flat[mine[0]] + mine[1], mine[2]) + _ranges(mine[2])] = True
    left = np.flatnonzero(~settled)
    if len(left):
        yield _rows(OPEN + kind, gram[r[left]], fp[r[left]], i[left], 1, key[left], 0, 0, 0)


def solve(table: pa.Table, length: int, report: int, cell: int) -> Iterator[pa.RecordBatch]:
    """A bucket of segments (t0, t1, t2, t3, gram, fp, n, low, high, windows, offset, text)."""
    cols = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in table.column_names[:-1]}
    texts = S.texts(table.column("text"))
    size = np.array([len(x) for x in texts])
    b = Bucket(np.concatenate(texts), np.cumsum(size) - size, size, cols["windows"], cols["offset"], cols["gram"].view(_U), cols["n"], cols["low"], cols["high"], cell)
    gram, fp = cols["gram"], cols["fp"]
    order = np.lexsort([cols[c] for c in ("fp", "t3", "t2", "gram", "t1", "t0")])
    ends = np.flatnonzero((gram == gram[order[0]]) | (gram == gram[order[-1]]))
    classes, begin = None, 0
    levels = [(report, SHARED), (length, REMOVED)] if report < length else [(length, SHARED), (length, REMOVED)]
    for n, kind in levels:
        found, classes = b.repeats(n, kind, classes, begin)
        begin = max(n - cell + 1 - 8, 0)
        known = runs(found)
        if known.shape[1]:
            yield _rows(kind, gram[known[0]], fp[known[0]], known[1], known[2], 0, 0, 0, 0)
        yield from _edges(b, ends, gram, fp, n, kind, known)


def _buckets(length: int, report: int, cell: int):
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from solve(pa.Table.from_batches(held), length, report, cell)

    return buckets


_TOKENS = ["t0", "t1", "gram", "t2", "t3", "fp"]
_PARTS = "t0 bigint, t1 bigint, t2 bigint, t3 bigint, gram bigint, fp bigint, n bigint, low bigint, high bigint, windows bigint, offset bigint, text binary"


def _parts(length: int, gram: int):
    """(text, places) to a row for each segment: its leading tokens and its bytes."""
    names = [f.split()[0] for f in _PARTS.split(", ")]

    def lead(text: bytes, at: int) -> int:
        return int.from_bytes(text[at : at + 8].ljust(8, b"\0"), "big") - (1 << 63)  # signed, in the same order

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for text, places in zip(S.texts(b.column(0)), b.column(1)):
                for p in places.as_py():
                    first, n, offset = S.place(p["at"])
                    part = text[first : first + n - 1 + length].tobytes()
                    at = (offset, offset + 8, offset + gram, offset + gram + 8)
                    rows.append((*(lead(part, x) for x in at), p["gram"], p["fp"], p["n"], p["low"], p["high"], n, offset, part))
                if len(rows) > 10_000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "text" else pa.int64()) for c, k in zip(zip(*rows), names)], names=names)

    return cut


def repeats(rows: DataFrame, length: int = LENGTH, report: int = REPORT, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """(did, rk, a, b, kind): intervals of bytes covered by strings that start elsewhere too."""
    fold = min(length, report)
    found, distinct = S.repeated(rows, S.byte_codes, fold, gram, length)
    parts = materialize(S.with_texts(rows, distinct, ["at", "gram", "fp", "n", "low", "high"]).mapInArrow(_parts(length, gram), _PARTS), "parts")
    total = parts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = parts.repartitionByRange(partitions(rows.sparkSession, total, BUCKET), *_TOKENS)
    out = materialize(dealt.mapInArrow(_buckets(length, min(length, report), cell), _OUT), "buckets")
    sums = out.filter(F.col("kind") >= SUM).groupBy((F.col("kind") - SUM).alias("kind"), "gram", "key").agg(F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
    twice = sums.filter(F.when(F.col("kind") == REMOVED, F.col("weight") >= 2).otherwise(F.col("low") != F.col("high"))).select("kind", "gram", "key")
    left = out.filter(F.col("kind").isin(OPEN, OPEN + 1)).withColumn("kind", F.col("kind") - OPEN)
    across = left.join(twice, ["kind", "gram", "key"]).select("gram", "fp", "i", "windows", "kind")
    known = out.filter(F.col("kind") < OPEN).select("gram", "fp", "i", "windows", "kind").unionByName(across)
    return S.placed(found.join(known, ["gram", "fp"]), F.when(F.col("kind") == REMOVED, length).otherwise(fold), "kind")


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans): what is left of each text."""
    run = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), run]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "spans"]
    for b in batches:
        raw, rows = S.texts(b.column(1)), []
        for doc, text, spans in zip(b.column(0), raw, b.column(2)):
            found = spans.as_py() or ()
            gone = S.union([s for s in found if s["kind"] == REMOVED])
            shared = S.union([s for s in found if s["kind"] == SHARED])
            kept, at = hashlib.sha256(), 0
            for x, y in gone:
                kept.update(text[at:x].tobytes())
                at = y
            kept.update(text[at:].tobytes())
            rows.append((doc.as_py(), len(text), sum(y - x for x, y in gone), len(gone), kept.hexdigest(), sum(y - x for x, y in shared), [{"a": x, "b": y} for x, y in gone]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def dedup_bytes(df: DataFrame, key: str = "doc_id", length: int = LENGTH, report: int = REPORT, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """For each row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, spans).

    n_shared: bytes covered by a string of ``report`` bytes that starts under another key too.
    Matches never cross rows and are judged on the input. Null texts are empty; texts shorter than
    ``length`` lose nothing; repeated rows lose all if they are as long. Null keys are kept and
    count as one key. Very long texts are scanned in overlapping pieces; an empty table gives an
    empty one; columns other than the key and ``text`` are ignored, whatever their names.
    """
    rows = S.keyed(df, key)
    found = materialize(S.intervals(repeats(rows, length, report, gram, cell), "kind"), "spans")
    all_rows = S.keyed(df, key, "doc_id")
    joined = all_rows.join(found, ["did", "rk"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_rest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared bigint, spans array<struct<a:bigint,b:bigint>>")


def dedup_documents(documents: DataFrame) -> DataFrame:
    return dedup_bytes(documents).drop("spans")
