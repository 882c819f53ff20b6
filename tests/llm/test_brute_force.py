"""op1 and op7 row by row: the permutation and the curriculum worked out again in plain Python."""

from __future__ import annotations

import random
import re
import struct
import zlib

import pytest
import xxhash

from ravine.llm import mixing, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*values, seed=42):
    """Spark's xxhash64: each value's hash is the next one's seed; nulls are passed over. Whole numbers in a
    list are 32 bits wide."""
    for v in values:
        if v is not None:
            data = struct.pack("<i", v[0]) if isinstance(v, list) else v.encode() if isinstance(v, str) else struct.pack("<q", v)
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def made(n, seed):
    rng = random.Random(seed)
    texts = ["", None, "one", "a b\tc d", "x " * 400, "日本 語", *(" ".join(rng.choices("alpha beta gamma".split(), k=rng.randrange(60))) for _ in range(20))]
    rows = [(rng.choice([i, i, i, rng.randrange(n), None]), rng.choice(texts), "en", rng.choice(["s1"] * 5 + ["s2", "s3", "", None]), 0) for i in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("n, shards", [(1, 16), (7, 3), (150, 16)])
def test_every_slot(spark, n, shards):
    rows = made(n, n)
    keys = [(d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, *_ in rows]
    order = sorted(keys, key=lambda k: (h(k[0]) % sharding.BUCKETS, k[0] is not None, k[0] or 0, k[1], k[2]))
    total = len(order)
    a = int((total - 1) ** 0.5) + 1
    b = -(-total // a)

    def step(x):
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            if i % 2:
                right = (right + h([42], [i], left) % b) % b
            else:
                left = (left + h([42], [i], right) % a) % a
        return left * b + right

    want = []
    for number, k in enumerate(order):
        place = step(number)
        while place >= total:
            place = step(place)
        want.append((*k, place % shards, place // shards))
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS).repartition(3), shards).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text_crc32, r.size, r.shard, r.slot)) for r in got)


def due(schedule, share):
    """When the schedule's integral reaches a share of it, by halving."""
    def area(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            x = min(max(t, t0), t1) - t0
            out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return out

    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if area(mid) < share * area(1.0) else (low, mid)
    return high


def test_every_document_of_the_mix(spark):
    rows = made(160, 9)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for *_, s, _ in rows if s is not None}) + [None]
    sizes = {s: sum(size(t) for _, t, _, x, _ in rows if x == s) for s in sources}
    weights = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} if over else {s: level * weights[s] for s in open_}
        open_ = open_ - over if over else set()
    want = []
    for i, s in enumerate(sources):
        own = [(d, size(t), t) for d, t, _, x, _ in rows if x == s]
        own.sort(key=lambda r: (h([7], r[0]) % mixing.BUCKETS, h([7], r[0]), r[0] is not None, r[0] or 0, r[1], h(r[2])))
        asked, begins = int(target[s] + 0.5), 0
        for d, n, _ in own:
            rounds, rest = divmod(asked, sizes[s]) if sizes[s] else (1, 0)
            taken = n * rounds + min(max(rest - begins, 0), n)
            copies = rounds + (begins + n // 2 < rest)
            at = due(mixing.SCHEDULES[i % 3], min(begins / max(asked, 1), 1.0)) if copies else None
            want.append((str(d), n, taken, copies, at if at is None else round(at, 6)))
            begins += n
    got = [(str(r.doc_id), r.size, r.taken, r.copies, r.position if r.position is None else round(r.position, 6)) for r in mixing.mix_documents(spark.createDataFrame(rows, DOCS).repartition(4)).collect()]
    key = lambda r: (r[0], r[1], r[2], r[3], r[4] or -1)
    for a, b in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
        assert a[:4] == b[:4] and (a[4] is None) == (b[4] is None) and abs((a[4] or 0) - (b[4] or 0)) < 2e-6, (a, b)
