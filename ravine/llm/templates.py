"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so an item asked again with other values
keeps its template. Windows of ``WINDOW`` template words are hashed; the benchmark's are joined to
those of every document, and the values in the slots are compared: within an item, equal values
must have been replaced by equal values, and windows that break the mapping don't count. That is
judged for each occurrence, the windows on about one alignment of document and item, and for the
document as a whole. A document has leaked an item if the windows left in one of these cover
``RUN`` neighbouring words of it, or ``SHARE`` of it.

Whether a word is a name hangs on its capital and on the text before it, so a window with names is
also read with the names as words, and one that begins with a name with that as a word. A window
with slots is also read word by word, as it stands. That reading has no slots to compare and needs
no literal words, so a verbatim copy matches whatever its share of numbers and names.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ravine.llm import spans as S
from ravine.llm.common import materialize
from ravine.llm.nbsvm import _hash

WINDOW = 8
#: Literal words that a window must have, if it has slots.
LITERAL = 4
RUN, SHARE = 13, 0.8
#: Words by which the alignment may shift within an occurrence; a quarter of the item at most.
SLACK = 8
#: Benchmark windows that a pass over the documents looks for; more are looked for in blocks.
BLOCK = 2_000_000
#: Windows that more items than this share don't make a pair of document and item alone, unless an
#: item's windows of this kind are enough for a leak.
MANY = 50

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^[\W_]+|[^\w%]+$")
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?%?$")
_MEASURED = re.compile(r"[+-]?\d[\d.,]*[a-z°]+$", re.I)
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees celsius fahrenheit mph kph watt watts volt volts".split())

_CAPITAL, _STOP, _SLOT, _EMPTY = 1, 2, 4, 8
NAME = np.uint64(_hash("\0name"))


class Canon:
    """Texts to template codes and slot values; words seen before come from a table."""

    def __init__(self, size: int = 400_000):
        self.size = size
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {}
        self.codes, self.flags = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)
        self.plain = np.zeros(1 << 12, np.uint64)
        self.raw: list[str] = []

    def _add(self, word: str) -> None:
        bare = _EDGES.sub("", word)
        flag = _STOP if word.rstrip("\"')]}»”")[-1:] in ".!?:" else 0
        low = bare.lower()
        if not bare:
            code, flag = 0, flag | _EMPTY
        elif _NUMBER.match(bare):
            code, flag = _hash("\0number"), flag | _SLOT
        elif _MEASURED.match(bare):
            code, flag = _hash("\0measure"), flag | _SLOT
        elif low in UNITS:
            code, flag = _hash("\0unit"), flag | _SLOT
        else:
            code, flag = _hash(low), flag | (_CAPITAL if bare[0].isupper() and not bare.isupper() else 0)
        n = len(self.raw)
        if n == len(self.codes):
            self.codes, self.flags, self.plain = (np.concatenate([x] * 2) for x in (self.codes, self.flags, self.plain))
        self.codes[n], self.flags[n], self.plain[n] = code, flag, _hash(low) if flag & _SLOT else code
        self.raw.append(low)
        self.at[word] = n

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes with names as words, whether each is a slot, whether it is a name inside a sentence,
        and the numbers of the words (see ``raw``)."""
        if len(self.at) > self.size:
            self._clear()
        words, at = _WORD.findall(text or ""), self.at
        try:
            found = [at[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in at:
                    self._add(w)
            found = [at[w] for w in words]
        found = np.array(found, np.int64)
        flags = self.flags[found]
        kept = np.flatnonzero(flags & _EMPTY == 0)
        stops = np.concatenate([[0], np.cumsum(flags & _STOP > 0)])
        fresh = np.ones(len(kept), bool)  # a sentence ended since the word before
        fresh[1:] = stops[kept[1:]] > stops[kept[:-1]]
        found, flags = found[kept], flags[kept]
        return self.codes[found], flags & _SLOT > 0, (flags & _CAPITAL > 0) & ~fresh, found


@functools.cache
def shared_canon() -> Canon:
    """The worker's table of words, which outlives a task."""
    return Canon()


def windows(canon: Canon, text: str | None, lengths: list[int]):
    """(length, starts, hashes, slots, first) of each reading and length, the words' numbers, their count.

    The readings: the template; that with a name at the window's start as a word (its slots begin at
    ``first``, 1); that with all names as words, where there are any; the words as they stand, where
    the template has a slot.
    """
    codes, typed, names, found = canon(text)
    template = codes.copy()
    template[names] = NAME
    slots, none, out = typed | names, np.zeros(len(codes), bool), []
    whole, plain, any_names = S.Sums(template), S.Sums(canon.plain[found]), names.any()
    named = S.Sums(codes) if any_names else None
    filled, of_names = (np.concatenate([[0], np.cumsum(x)]) for x in (slots, names))

    def add(n, where, sums, slots, first=None):
        start = np.flatnonzero(where)
        if len(start):
            hashes = (sums.sums[start + n] - sums.sums[start]) * sums.up[start]
            if first is not None:
                hashes += first[start]
            out.append((n, start, S.mix(hashes) + np.uint64(n), slots, int(first is not None)))

    for n in lengths:
        if len(codes) >= n:
            words, enough = n - filled[n:] + filled[:-n], min(LITERAL, n)
            add(n, words >= enough, whole, slots)
            if any_names:
                held = of_names[n:] - of_names[:-n]
                add(n, names[: len(held)] & (words + 1 >= enough), whole, slots, codes - template)
                add(n, (held > 0) & (words + held >= enough), named, typed)
            add(n, words < n, plain, none)
    return out, found, len(codes)


def values(canon: Canon, slots: np.ndarray, found: np.ndarray, start: int, n: int) -> str:
    """The slot values of a window, in order."""
    return "\x1f".join(canon.raw[found[i]] for i in range(start, start + n) if slots[i])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to (item_id, window, start, length, words, item_values)."""
    canon = shared_canon()
    for b in batches:
        rows = []
        for item, text in zip(b.column(0), b.column(1)):
            total = len(canon(text.as_py())[0])
            if not total:
                continue
            out, found, total = windows(canon, text.as_py(), [min(WINDOW, total)])
            for n, start, hashes, slots, first in out:
                for s, h in zip(start.tolist(), hashes.view(np.int64).tolist()):
                    rows.append((item.as_py(), h, s, n, total, values(canon, slots, found, s + first, n - first)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["item_id", "window", "start", "length", "words", "item_values"])


def _scan(wanted: np.ndarray, lengths: list[int]):
    """(did, rk, text) to (did, rk, window, doc_values, starts): each row's wanted windows and their places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, top = shared_canon(), np.uint64(64 - 22)
        some = np.zeros(1 << 22, bool)  # leading bits of the wanted: most windows go by these
        some[wanted >> top] = True
        for b in batches:
            rows = []
            for did, rk, text in zip(*(b.column(i) for i in range(3))):
                out, found, _ = windows(canon, text.as_py(), lengths)
                for n, start, hashes, slots, first in out:
                    hit = np.flatnonzero(some[hashes >> top])
                    at = np.searchsorted(wanted, hashes[hit])
                    at[at == len(wanted)] = 0
                    hit = hit[wanted[at] == hashes[hit]]
                    places: dict[tuple[int, str], list[int]] = {}
                    for s, h in zip(start[hit].tolist(), hashes[hit].view(np.int64).tolist()):
                        places.setdefault((h, values(canon, slots, found, s + first, n - first)), []).append(s)
                    for (h, v), at in places.items():
                        rows.append((did.as_py(), rk.as_py(), h, v, at))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["did", "rk", "window", "doc_values", "starts"])

    return scan


def consistent(found: list[tuple[int, int, str, str]]) -> tuple[list[tuple[int, int]], bool]:
    """(start, length, item values, document values) of windows: the intervals whose slots keep one
    mapping of item values to document values, and whether any value was replaced.

    An item value goes with the document value that most windows give it (the least of equals).
    """
    votes: dict[str, Counter] = {}
    pairs = []
    for start, n, a, b in found:
        slots = list(zip(a.split("\x1f"), b.split("\x1f"))) if a or b else []
        pairs.append((start, n, slots))
        for x, y in slots:
            votes.setdefault(x, Counter())[y] += 1
    chosen = {x: min(c, key=lambda y: (-c[y], y != x, y)) for x, c in votes.items()}
    kept = [(s, n) for s, n, slots in pairs if all(chosen[x] == y for x, y in slots)]
    return kept, any(x != y for s, n, slots in pairs for x, y in slots if chosen[x] == y)


def occurrence(found: list[tuple[int, int, str, str, list[int]]], total: int) -> tuple[int, int, bool] | None:
    """(covered, run, changed) of the best occurrence of an item of ``total`` words, if one is a leak.

    ``found`` is what ``consistent`` takes and the starts in the document. Each alignment is judged
    alone, then with those up to ``SLACK`` words on, and last all windows of the document together.
    """
    on: dict[int, set[int]] = {}  # alignment: its windows
    for i, f in enumerate(found):
        for s in f[4]:
            on.setdefault(s - f[0], set()).add(i)
    slack, order = min(SLACK, total // 4), sorted(on)
    groups = {frozenset(range(len(found)))}
    for k, d in enumerate(order):
        near = [on[e] for e in order[k : k + slack + 1] if e <= d + slack]
        groups |= {frozenset(near[0]), frozenset().union(*near)}
    best = None
    for g in groups:
        if sum(found[i][1] for i in g) < min(RUN, SHARE * total):
            continue
        kept, changed = consistent([found[i][:4] for i in g])
        runs = S.union([{"a": s, "b": s + n} for s, n in kept])
        run, covered = max((y - x for x, y in runs), default=0), sum(y - x for x, y in runs)
        if run >= RUN or covered >= SHARE * total:
            best = max(best or (0, 0, False), (covered, run, not changed))
    return best and (best[0], best[1], not best[2])


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, rk, item_id, words, found) to leaks."""
    for b in batches:
        rows = []
        for did, rk, item, words, found in zip(*(b.column(i) for i in range(5))):
            best = occurrence([(f["start"], f["length"], f["item_values"], f["doc_values"], f["starts"]) for f in found.as_py()], words.as_py())
            if best:
                covered, run, changed = best
                rows.append((did.as_py(), rk.as_py(), item.as_py(), run, covered / words.as_py(), changed))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["did", "rk", "item_id", "run", "coverage", "reparameterised"])


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words, spans) to the items that these windows alone could show as leaked."""
    for b in batches:
        ok = []
        for words, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            runs = S.union(spans)
            ok.append(max((y - x for x, y in runs), default=0) >= RUN or sum(y - x for x, y in runs) >= SHARE * words)
        yield b.select([0]).filter(pa.array(ok, pa.bool_()))


def _telling(items: DataFrame) -> DataFrame:
    """(item_id, window): the windows that make a document a candidate for an item.

    Windows that many items share would pair every document that has one with all of these. They are
    left out for items that they can't show as leaked without another window; once a pair is made,
    all windows count.
    """
    often = items.select("window", "item_id").distinct().groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY).select("window", F.lit(True).alias("often"))
    marked = materialize(items.join(often, "window", "left").select("item_id", "window", "start", "length", "words", F.coalesce("often", F.lit(False)).alias("often")), "telling")
    spans = marked.filter("often").groupBy("item_id").agg(F.max("words").alias("words"), F.collect_list(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b"))).alias("spans"))
    alone = spans.mapInArrow(_enough, "item_id bigint").withColumn("alone", F.lit(True))
    return marked.join(alone, "item_id", "left").filter("not often or alone").select("item_id", "window").distinct()


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(did, rk, doc_id, item_id, run, coverage, reparameterised): a row for each leaked item.

    Null texts have no windows; items without ``LITERAL`` literal words in a window (or as many as
    they have) match verbatim copies only. Rows of equal key and text count once, null keys too.
    Repeated items are reported each; very long texts are read whole; empty documents or an empty
    benchmark give no row; other columns are ignored, whatever their names.
    """
    items = materialize(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(_items, "item_id bigint, window bigint, start int, length int, words int, item_values string"), "items")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # WINDOW values at most
    n = items.select("window").distinct().count()
    blocks, rows = max(1, -(-n // BLOCK)), S.keyed(df, key)
    found = None
    for k in range(blocks):  # a bounded part of the benchmark against all rows
        wanted = items.select("window").distinct().filter(F.pmod("window", F.lit(blocks)) == k).toPandas()
        hashes = np.sort(wanted.window.to_numpy(np.int64).view(np.uint64))
        if not len(hashes):
            continue
        part = rows.mapInArrow(_scan(hashes, lengths), "did bigint, rk bigint, window bigint, doc_values string, starts array<int>")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "did bigint, rk bigint, window bigint, doc_values string, starts array<int>")
    found = materialize(found.distinct(), "windows")
    pairs = found.select("did", "rk", "window").distinct().join(_telling(items), "window").select("did", "rk", "item_id").distinct()
    joined = pairs.join(items, "item_id").join(found, ["did", "rk", "window"]).groupBy("did", "rk", "item_id").agg(F.max("words").alias("words"), F.collect_list(F.struct("start", "length", "item_values", "doc_values", "starts")).alias("found"))
    out = joined.select("did", "rk", "item_id", "words", "found").mapInArrow(_verdicts, "did bigint, rk bigint, item_id bigint, run int, coverage double, reparameterised boolean")
    return out.withColumn("doc_id", F.when(F.col("did") != (1 << 63) - 1, F.col("did")))


def leaked_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, run, coverage, reparameterised) of every leak."""
    return leaks(documents, benchmark).select("doc_id", "item_id", "run", "coverage", "reparameterised")
