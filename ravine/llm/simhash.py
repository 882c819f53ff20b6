"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their bit counts is its
embedding. One differing bit changes one count by one, so the Manhattan distance of two embeddings
is a lower bound of the Hamming distance of the fingerprints: a range join at radius 3 in the
embedding misses no link. The join runs over a grid: the 32 axes are dealt to six groups, and of
two points within distance 3 at least three groups agree in every coordinate. Each of the 20
choices of three groups is a projection, and a grid cell is the exact coordinates there; both
points of a link meet in at least one cell. In a cell, the Manhattan bound prunes and the Hamming
distance decides.

Only distinct fingerprints are joined; documents with equal ones are one node. A large cell returns
a spanning forest of its links, never its pairs. Cells with more than ``BLOCK`` fingerprints are cut
into blocks, each pair of blocks a task of its own.

``keep_one`` links by similarity instead: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. 64 bits can't tell these, as they differ in some ten bits. It takes 256
bits of the set's shingles, of which such texts differ in 38.8 on average, and takes pairs up to two
standard deviations above as candidates. No choice of a few groups agrees at that radius, so its
grid isn't exact: a cell is a number of bits (segments of one bit, whose Manhattan distance is the
Hamming distance) of a second fingerprint, of two-word shingles, which an edit moves less; cells
hold about ``CELL`` nodes at every size of the corpus, and there are so many tables of cells that
two texts at the threshold meet with a probability of 0.95, closer ones with a higher. Candidates
are verified by the shingle sets themselves: all pairs of a group of up to ``GROUP`` texts that
candidates connect. Of a larger group the candidates are verified first, which are its cells' minimum
spanning forests; where that leaves it in parts, all texts of different parts are compared, block by
block, and each pair of blocks returns only links that connect parts, never pairs.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ravine.llm import spans as S
from ravine.llm.common import materialize, row_key

RADIUS = 3
SEGMENTS = 32
GROUPS = 2 * RADIUS
SHINGLE = 3
SEED = 42
#: Fingerprints of a cell that are compared in one task.
BLOCK = 50_000

#: The rule of ``keep_one``: similarity of five-word shingle sets, in so many 64-bit words; the
#: words of its grid's fingerprint and the shingles of that.
SIMILAR, SIMILAR_SHINGLE, SIMILAR_WORDS = 0.8, 5, 4
GRID_SHINGLE, GRID_WORDS = 2, 2
#: Nodes in a cell, about; cells up to PAIRS are compared pair by pair. Groups that are verified whole.
CELL, PAIRS, GROUP = 16, 32, 64
#: Texts, and bytes of their shingles, in a block of a larger group that is in parts.
PART_BLOCK, PART_BYTES = 2048, 8 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; no word: zero."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        hashes = np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i : i + size]), SEED) for i in range(at, min(n, at + 65_536))), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
        rest = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(prints)], names=[*b.schema.names[:-1], "fp"])


def with_fingerprints(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of ``df`` and ``fp``, the fingerprint of ``text`` as a signed long."""
    small = df.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields[:-1])
    return small.mapInArrow(_fingerprints, f"{fields}, fp bigint")


def embed(fps: np.ndarray) -> np.ndarray:
    """Per-segment bit counts of unsigned fingerprints, two bits a segment: the counts' own 64 bits."""
    ones = np.uint64(0x5555555555555555)
    return (fps & ones) + ((fps >> np.uint64(1)) & ones)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of packed embeddings (counts 0, 1, 2 in two bits)."""
    low = np.uint64(0x5555555555555555)
    x = a ^ b  # 1: 0-1; 2: 0-2; 3: 1-2
    high, odd = (x >> np.uint64(1)) & low, x & low
    return np.bitwise_count(odd) + 2 * np.bitwise_count(high & ~odd)


def _masks() -> list[int]:
    """For each choice of half the groups, the bits of the segments in them."""
    groups = [sum(3 << (2 * s) for s in range(g, SEGMENTS, GROUPS)) for g in range(GROUPS)]
    return [sum(c) for c in itertools.combinations(groups, GROUPS - RADIUS)]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint in its cell of every projection: (cell, fp)."""
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        points = embed(fps)
        for i, mask in enumerate(_masks()):
            cell = points & np.uint64(mask)
            cell = (cell ^ (cell >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
            cell = (cell ^ (cell >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fps.view(np.int64))], names=["cell", "fp"])


def spanning(points: np.ndarray, radius: int, side: np.ndarray | None = None, bound: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of 64-bit words) that connect what lies within ``radius``: a spanning forest.

    A breadth-first search: each point is compared with those not reached yet, so a dense cell
    costs about its size. With ``side``, only links between the two sides are searched. ``bound``:
    the Manhattan distance of the embeddings prunes before the Hamming distance decides.
    """
    embedded, left = embed(points) if bound else None, np.arange(len(points))
    out_a, out_b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            at = np.arange(len(left))
            if side is not None:
                at = at[side[left] != side[i]]
            if bound:
                at = at[manhattan(embedded[left[at]], embedded[i]).sum(axis=1) <= radius]
            at = at[np.bitwise_count(points[left[at]] ^ points[i]).sum(axis=1) <= radius]
            if len(at):
                found = left[at]
                out_a.append(np.full(len(found), i))
                out_b.append(found)
                queue.extend(found.tolist())
                keep = np.ones(len(left), bool)
                keep[at] = False
                left = left[keep]
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def nearest_forest(points: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``spanning``, by short links first: a longer one only joins what shorter ones don't connect."""
    parent, out = list(range(len(points))), ([], [])

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for level in sorted({radius * k // 5 for k in range(1, 6)}):
        for a, b in zip(*(x.tolist() for x in spanning(points, level, side))):
            x, y = find(a), find(b)
            if x != y:
                parent[y] = x
                out[0].append(a)
                out[1].append(b)
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def forest(fps: np.ndarray, against: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between fingerprints within RADIUS, as ``spanning``; with ``against``, between these two."""
    points = fps if against is None else np.concatenate([fps, against])
    side = None if against is None else np.arange(len(points)) >= len(fps)
    a, b = spanning(points[:, None], RADIUS, side, bound=True)
    return points[a], points[b]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, block pair): the links of each cell. Reads a cell at a time."""
    def emit(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def solve(cell, pair, side, fps):
        ends = np.flatnonzero((cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])) + 1
        starts = np.concatenate([[0], ends])
        sizes = np.diff(np.concatenate([starts, [len(cell)]]))
        two = starts[(sizes == 2) & (side[starts] == 0)]
        two = two[(np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS) & (side[two + 1] == 0)]
        a, b = [fps[two]], [fps[two + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            group, other = fps[s : s + n], side[s : s + n]
            x, y = forest(group[other == 0], group[other == 1]) if other.any() else forest(group)
            a.append(x)
            b.append(y)
        for s in starts[(sizes == 2) & (side[starts] == 0)].tolist():
            if side[s + 1] and int(fps[s] ^ fps[s + 1]).bit_count() <= RADIUS:
                a.append(fps[s : s + 1])
                b.append(fps[s + 1 : s + 2])
        return np.concatenate(a), np.concatenate(b)

    for cell, pair, side, fps in _whole(batches):
        yield emit(*solve(cell, pair, side, fps.view(np.uint64)))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first two, so that equal pairs of these come together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not len(cols[0]):
            continue
        held = held or [[] for _ in cols]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if not cut and held[0] and held[0][-1][-1] == cols[0][0] and held[1][-1][-1] == cols[1][0]:
            for h, c in zip(held, cols):
                h.append(c)
            continue
        done = [np.concatenate([*h, c[:cut]]) for h, c in zip(held, cols)]
        held = [[c[cut:]] for c in cols]
        if len(done[0]):
            yield done
    if held:
        yield [np.concatenate(h) for h in held]


def _in_blocks(cells: DataFrame, by: str, *rest: str, blocks: Column | None = None) -> DataFrame:
    """Rows of cells dealt by (cell, pair of blocks), sorted by these, side and ``by``. blocks: the
    aggregate of a cell's rows that says how many it has; one for each BLOCK rows if there is none."""
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK) if blocks is None else blocks
    large = cells.groupBy("cell").agg(blocks.cast("int").alias("blocks")).filter("blocks > 1")
    own = F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")
    cells = cells.join(large, "cell", "left").withColumn("own", F.coalesce(own, F.lit(0)))
    # block i meets every block j >= i in the task (i, j); its rows are side 0 there, j's side 1
    with_ = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.struct((F.least(j, F.col("own")) * F.lit(1 << 20).cast("long") + F.greatest(j, F.col("own"))).alias("pair"), (j < F.col("own")).cast("int").alias("side")))
    dealt = cells.select("cell", by, *rest, F.explode(with_).alias("to")).select("cell", F.col("to.pair").alias("pair"), F.col("to.side").alias("side"), by, *rest)
    return dealt.repartition("cell", "pair").sortWithinPartitions("cell", "pair", "side", by)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``fp``, enough to connect every component."""
    cells = materialize(distinct.select("fp").mapInArrow(_cells, "cell bigint, fp bigint"), "cells")
    return _in_blocks(cells, "fp").mapInArrow(_links, "a bigint, b bigint").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest other node that each node of ``edges`` reaches; roots have no row.

    Large-star and small-star rounds over the edges only; every round is a table in the shared
    folder. A hub's edges are aggregated before the shuffle (min), not gathered.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u goes to u's smallest
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of these
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == (now[0], now[1]):
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = (now[0], now[1])


def _classes(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, root, component) of nodes (node, least): the component's least node and least key."""
    found = materialize(components(edges), "components").withColumnRenamed("node", "__node")
    of = nodes.join(found, nodes[node] == found["__node"], "left").select(node, "least", F.coalesce("root", node).alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component"))
    return materialize(of.join(smallest, "root").select(node, "root", "component"), "classes")


def near_duplicates(df: DataFrame, key: str = "doc_id", *keep: str) -> DataFrame:
    """(key, keep..., fp, root, component): each row's fingerprint, its component's least
    fingerprint and the smallest key that it reaches.

    Null and empty texts have fingerprint zero and are linked like any other. A null key is never
    the smallest unless a component has no other. Repeated rows are in one component. Very long
    texts are counted in parts; an empty table gives an empty one; other columns are ignored.
    """
    rows = materialize(with_fingerprints(df, key, *keep), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    return rows.join(_classes(nodes, links(nodes), "fp"), "fp").select(key, *keep, "fp", "root", "component")


_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """The different hashes of a text's shingles; of a shorter text, its whole sequence's."""
    if not len(codes):
        return np.empty(0, np.uint64)
    sums = S.Sums(codes)
    return np.unique(sums.each(min(size, len(codes))))


def signs(hashes: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set of hashes in so many 64-bit words; of none: zero."""
    ones = np.zeros(64 * words, np.int64)
    salts = S.mix(np.arange(1, words + 1, dtype=np.uint64))
    for at in range(0, len(hashes), 32_768):
        grid = np.stack([S.mix(hashes[at : at + 32_768] + salt) for salt in salts], axis=1)
        ones += np.unpackbits(grid.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def similar_prints(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's fingerprints for ``keep_one``: that which decides, and that of its grid."""
    codes = S.word_codes(_LOWER_BYTES[text])
    return signs(shingles(codes, SIMILAR_SHINGLE), SIMILAR_WORDS), signs(shingles(codes, GRID_SHINGLE), GRID_WORDS)


def similar_radius(similarity: float = SIMILAR, words: int = SIMILAR_WORDS) -> int:
    """Bits in which sets of equal size and this Jaccard similarity differ: mean and two standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(64 * words * share + 2 * math.sqrt(64 * words * share * (1 - share)))


def grid(n: int) -> tuple[int, int]:
    """Bits of a cell and number of tables for n nodes."""
    kept = 1 - 2 * (1 - SIMILAR) / (1 + SIMILAR) / SIMILAR_SHINGLE * GRID_SHINGLE / 2  # cosine of the two-word sets
    agree = 1 - math.acos(kept) / math.pi
    bits = min(60, max(4, math.ceil(math.log2(max(n, 2) / CELL))))
    return bits, math.ceil(math.log(20) / agree**bits)


_PRINT = [f"f{i}" for i in range(SIMILAR_WORDS)]
_GRID = [f"g{i}" for i in range(GRID_WORDS)]


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = [np.concatenate(similar_prints(t)) for t in S.texts(b.column(2))]
        prints = np.array(both, np.uint64).reshape(-1, SIMILAR_WORDS + GRID_WORDS).view(np.int64)
        cols = [pa.array(np.ascontiguousarray(c)) for c in prints.T]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=[*b.schema.names[:2], *_PRINT, *_GRID])


def _tables(bits: int, tables: int):
    """Each node in its cell of every table: (cell, node, print)."""
    rng = np.random.default_rng(7)
    masks = []
    for _ in range(tables):
        mask = np.zeros(64 * GRID_WORDS, np.uint8)
        mask[rng.permutation(64 * GRID_WORDS)[:bits]] = 1
        masks.append(np.packbits(mask, bitorder="little").view(np.uint64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = np.stack([b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in _GRID], axis=1)
            for i, mask in enumerate(masks):
                cell = np.full(len(points), i + 1, np.uint64)
                for k in range(GRID_WORDS):
                    cell = S.mix(cell * np.uint64(S.BASE) + (points[:, k] & mask[k]))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), *(b.column(c) for c in ("node", *_PRINT))], names=["cell", "node", *_PRINT])

    return deal


def _similar_links(radius: int):
    """Rows sorted by (cell, block pair): links of each cell, all of a small one, else a forest."""

    def solve(cell, pair, side, node, points):
        new = np.append(True, (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1]))
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        sizes = np.diff(np.append(starts, len(cell)))
        small = np.flatnonzero((sizes <= PAIRS)[group])
        out = []
        for step in range(1, PAIRS):
            small = small[small + step < len(cell)]
            small = small[group[small + step] == group[small]]
            if not len(small):
                break
            near = small[np.bitwise_count(points[small] ^ points[small + step]).sum(axis=1) <= radius]
            out.append((near, near + step))
        for s, n in zip(starts[sizes > PAIRS].tolist(), sizes[sizes > PAIRS].tolist()):
            own = side[s : s + n]
            a, b = nearest_forest(points[s : s + n], radius, own if own.any() else None)
            out.append((a + s, b + s))
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))
        return node[a], node[b]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, pair, side, node, *prints in _whole(batches):
            a, b = solve(cell, pair, side, node, np.stack([p.view(np.uint64) for p in prints], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return find


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have this Jaccard similarity at least; empty sets are alike."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, size, text): the text's shingles, 32 bits each, instead of the text."""
    for b in batches:
        found = [np.unique(shingles(S.word_codes(_LOWER_BYTES[t]), SIMILAR_SHINGLE).astype(np.uint32)).tobytes() for t in S.texts(b.column(3))]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.binary())], names=["node", "root", "size", "shingles"])


def _links_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])


def _groups(similarity: float):
    """Rows (root, node, shingles) sorted by root: links that connect what is alike in each group."""

    def solve(members: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        of, out = list(range(len(members))), []
        for i in range(len(members)):
            for j in range(i):
                if of[i] != of[j] and alike(members[i][1], members[j][1], similarity):
                    out.append((members[i][0], members[j][0]))
                    of = [of[j] if x == of[i] else x for x in of]
        return out

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []
        for b in batches:
            out = []
            for root, node, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if root != group:
                    out += solve(members)
                    group, members = root, []
                members.append((node, np.frombuffer(packed.as_py(), np.uint32)))
            yield _links_batch(out)
        yield _links_batch(solve(members))

    return check


def _pairs(similarity: float):
    """(a, b, one, other): the pairs whose shingles are alike."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[np.frombuffer(x.as_py(), np.uint32) for x in b.column(k)] for k in (2, 3)]
            ok = [alike(x, y, similarity) for x, y in zip(*sets)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return check


def between(side: np.ndarray, part: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different parts, enough to connect the parts that are alike; if there
    are two sides, only links from side 0 to side 1.

    Sets this similar share one of the first n - ceil(similarity * n) + 1 tokens of either when both
    put rare ones first, so each is counted against those alone that share such a token with it.
    Empty sets have one fingerprint and so are one text.
    """
    n = np.array([len(s) for s in sets])
    tokens, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(tokens))
    owner, starts = np.repeat(np.arange(len(sets)), n), np.cumsum(n) - n
    ranked = rank[at]
    ranked = ranked[np.lexsort([ranked, owner])]
    heads = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
    is_head = np.arange(len(ranked)) - starts[owner] < heads[owner]
    by_token = np.argsort(ranked[is_head], kind="stable")
    holders = owner[is_head][by_token]  # whose heads have a token, token by token
    ends = np.cumsum(np.bincount(ranked[is_head], minlength=len(tokens)))
    of, later, two = np.unique(part, return_inverse=True)[1], np.arange(len(sets)), side.any()
    mark, out = np.zeros(len(tokens), bool), []
    for i in np.flatnonzero(side == 0).tolist():
        met, own = np.zeros(len(sets), bool), ranked[starts[i] : starts[i] + n[i]]
        for k in own[: heads[i]].tolist():
            met[holders[ends[k - 1] if k else 0 : ends[k]]] = True
        met &= (of != of[i]) & (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i])) & (side == 1 if two else later > i)
        others = np.flatnonzero(met)
        if not len(others):
            continue
        mark[own] = True
        held = mark[np.concatenate([ranked[starts[j] : starts[j] + n[j]] for j in others.tolist()])]
        shared = np.add.reduceat(held, np.cumsum(n[others]) - n[others], dtype=np.int64)
        mark[own] = False
        for j in others[shared >= similarity * (n[i] + n[others] - shared)].tolist():
            if of[i] != of[j]:
                out.append((i, j))
                of[of == of[j]] = of[i]
    return out


def _between(similarity: float):
    """Rows (cell, pair, side, node, part, shingles) sorted by cell and pair: see ``between``. Reads a pair
    of blocks at a time."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        if not rows:
            return []
        side, node, part = (np.array([r[k] for r in rows]) for k in range(3))
        return [(int(node[i]), int(node[j])) for i, j in between(side, part, [r[3] for r in rows], similarity)]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for b in batches:
            out = []
            for cell, pair, side, node, part, packed in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (cell, pair) != task:
                    out += solve(rows)
                    task, rows = (cell, pair), []
                rows.append((side, node, part, np.frombuffer(packed, np.uint32)))
            yield _links_batch(out)
        yield _links_batch(solve(rows))

    return check


def _verified(texts: DataFrame, nodes: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) that exact similarity upholds. texts: __rk, text; nodes: node, __rk.

    They connect whatever is alike in a group that candidates connect, however large it is.
    """
    found = components(edges)
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())  # a root has no row of its own
    found = materialize(found, "candidate-groups")
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = found.join(sizes, "root").join(nodes, "node").select("node", "root", "size", "__rk")
    sets = texts.join(members, "__rk").select("node", "root", "size", "text").mapInArrow(_sets, "node bigint, root bigint, size bigint, shingles binary")
    sets = materialize(sets, "shingles")
    small = sets.filter(F.col("size") <= GROUP).select("root", "node", "shingles").repartition("root").sortWithinPartitions("root", "node").mapInArrow(_groups(similarity), "a bigint, b bigint")
    large = sets.filter(F.col("size") > GROUP).select("root", "node", "shingles").dropDuplicates(["node"])
    if large.isEmpty():
        return small
    one, other = (large.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    pairs = edges.join(one, "a").join(other, "b").select("a", "b", "of_a", "of_b").mapInArrow(_pairs(similarity), "a bigint, b bigint")
    pairs = materialize(pairs, "verified")
    parts = materialize(components(pairs).select(F.col("node").alias("__node"), F.col("root").alias("__part")), "parts")
    parted = large.join(parts, F.col("node") == F.col("__node"), "left").select(F.col("root").alias("cell"), "node", F.coalesce("__part", "node").alias("part"), "shingles")
    torn = parted.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("cell")
    rest = materialize(parted.join(torn, "cell", "left_semi"), "torn")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / PART_BLOCK), F.ceil(F.sum(F.length("shingles")) / PART_BYTES))
    across = _in_blocks(rest, "node", "part", "shingles", blocks=blocks).mapInArrow(_between(similarity), "a bigint, b bigint")
    return small.unionByName(pairs).unionByName(across)


def similar(df: DataFrame, key: str = "doc_id", *, similarity: float = SIMILAR) -> DataFrame:
    """(key, __rk, node, root, component): the rows' classes of similar texts, see ``keep_one``."""
    small = df.select(key, "__rk", "text")
    kind = small.schema[key].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in (*_PRINT, *_GRID))
    rows = small.mapInArrow(_similar, f"`{key}` {kind}, __rk bigint, {longs}").withColumn("node", F.xxhash64(*_PRINT))
    rows = materialize(rows, "prints")
    nodes = rows.groupBy("node").agg(F.min(key).alias("least"), *(F.first(c).alias(c) for c in ("__rk", *_PRINT, *_GRID)))
    nodes = materialize(nodes, "nodes")
    bits, tables = grid(nodes.count())
    cells = materialize(nodes.mapInArrow(_tables(bits, tables), "cell bigint, node bigint, " + ", ".join(f"{c} bigint" for c in _PRINT)), "cells")
    edges = _in_blocks(cells, "node", *_PRINT).mapInArrow(_similar_links(similar_radius(similarity)), "a bigint, b bigint").distinct()
    edges = _verified(small.select("__rk", "text"), nodes.select("node", "__rk"), materialize(edges, "candidates"), similarity)
    return rows.select(key, "__rk", "node").join(_classes(nodes.select("node", "least"), edges, "node"), "node")


def keep_one(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each class of similar texts, that with the smallest key.

    Texts without a word are one class; null keys are the smallest of a class only if it has no
    other; of rows repeated in key and text one stays. Every column of ``df`` is kept.
    """
    keyed = df.withColumn("__rk", row_key(key, "text"))
    found = similar(keyed, key).filter(F.col(key).eqNullSafe(F.col("component")))
    stay = materialize(found.groupBy("root").agg(F.min("__rk").alias("__stay")).select("__stay"), "representatives")
    kept = keyed.join(stay, F.col("__rk") == F.col("__stay"), "left_semi")
    first = Window.partitionBy("__rk").orderBy(F.col(key))  # rows repeated in key and text
    return kept.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "__rk")


def near_duplicate_documents(documents: DataFrame) -> DataFrame:
    out = near_duplicates(documents)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
