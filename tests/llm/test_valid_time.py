"""Sales with the versions valid when they were sold, against a plain loop over the batches."""

from __future__ import annotations

import random
import zlib
from datetime import datetime, timedelta

from ravine.llm import valid_time as vt

DAY0 = datetime(2024, 1, 1)
SALES = "sale_id bigint, client_id bigint, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, page string, kind string, slice int"
CHANGES = "change_id bigint, client_id bigint, seq bigint, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, batch int"


def plain(sales, changes, batches, days):
    """What the contract says, one batch after another."""
    low = datetime.min

    def batch(day):
        return batches - 1 if day is None else max(0, min(batches - 1, (day - 19723) * batches // days))

    day = lambda t: (t - datetime(1970, 1, 1)).days
    arrived = [batch(s[5] and day(s[5])) for s in sales]
    changes = [c for c in {c[:9] for c in changes} if c[4]]
    came = [batch(day(c[4]) + (zlib.crc32(str(c[0]).encode()) % 4 if c[0] is not None else 0)) for c in changes]
    order = lambda c: (c[4], low.year if c[2] is None else c[2] + 10, -1 if c[0] is None else c[0])
    out, waiting, held = [], [], {}
    for b in range(batches + 1):
        tops = [max((s[4] for s, a in zip(sales, arrived) if a < b and s[4]), default=None), max((c[4] for c, a in zip(changes, came) if a < b), default=None)]
        marks = [t - timedelta(hours=36) if t else low for t in tops]
        h = min(marks)
        for c, a in zip(changes, came):
            if a == b and c[4] < marks[1]:
                out.append(("late", c[0], b, None, None, None, None))
            elif a == b and c[1] is not None:
                held.setdefault(c[1], []).append(c)
        waiting += [s for s, a in zip(sales, arrived) if a == b]
        now = [s for s in waiting if b == batches or s[4] is None or s[4] < h]
        waiting = [s for s in waiting if not (b == batches or s[4] is None or s[4] < h)]
        for s in now:
            own = sorted(held.get(s[1], []), key=order) if s[1] is not None else []
            v = [c for c in own if s[4] and c[4] <= s[4]][-1:]
            out.append(("sale", s[0], b, len(own), *((v[0][0], None if v[0][8] is None else int(100 * v[0][8] + 0.5), v[0][3]) if v else (None, None, None))))
        for client, own in held.items():
            passed = sorted((c for c in own if c[4] <= h), key=order)
            held[client] = passed[-1:] + [c for c in own if c[4] > h]
    return sorted(out, key=str)


def made(n, seed, days):
    rng = random.Random(seed)
    when = lambda d: DAY0 + timedelta(hours=rng.randrange(int(d * 24)), microseconds=rng.choice([0, 0, 1, 999_999]))
    client = lambda: rng.choice([7, 7, 7, 7, 1, 2, 3, rng.randrange(30), None])
    sales, changes = [], []
    for i in range(n):
        at = when(days)
        arrived = rng.choice([at, at, at + timedelta(days=rng.randrange(9)), DAY0 - timedelta(days=3), None])
        sales.append((rng.choice([i, i, i // 5, None]), client(), "s", 1.0, rng.choice([at, at, at, at, None]), arrived, 1, "x", "y", 3))
        changes.append((rng.choice([i, i, i, None]), client(), rng.choice([0, 1, i, None]), rng.choice(["I", "U", "D", None]), rng.choice([when(days), when(days), changes[-1][4] if changes else None, None]), "w", "r", "c", rng.choice([1.5, 0.005, 99.995, None]), 5))
    return sales, changes + changes[: n // 10]


def rows(df):
    return sorted((tuple(r[c] for c in ("rec", "id", "batch", "n_held", "change_id", "balance_cents", "op")) for r in df.collect()), key=str)


def test_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(vt, "PAGES", 3)
    monkeypatch.setattr(vt, "LEAF", 8)
    sales, changes = made(260, 4, 40)
    s, c = spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(changes, CHANGES).repartition(2)
    want = plain(sales, changes, 4, 40)
    assert {r[0] for r in want} == {"sale", "late"} and len({r[2] for r in want}) == 5
    assert rows(vt.enrich(s, c, 4, 19723, 40, share=20)) == want  # clients in slices
    assert rows(vt.enrich(s, c, 4, 19723, 40, share=1)) == want  # none in slices


def test_empty_tables(spark):
    sales, changes = made(12, 1, 20)
    s, c = spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES)
    assert rows(vt.enrich(s, c.limit(0), 2, 19723, 20)) == plain(sales, [], 2, 20)
    assert rows(vt.enrich(s.limit(0), c, 2, 19723, 20)) == plain([], changes, 2, 20)
    assert rows(vt.enrich(s.limit(0), c.limit(0), 1, 19723, 20)) == []


def test_leaves_no_stores_open(spark):
    state = spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager
    stores = lambda: state.getNumRocksDBInstances(True) + state.getNumRocksDBInstances(False)
    threads = lambda: {t.getId() for t in spark._jvm.Thread.getAllStackTraces().keySet() if t.getName().startswith("ChecksumCheckpointFileManager")}
    opened, running = stores(), threads()
    sales, changes = made(12, 1, 20)
    s, c = spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES)
    assert rows(vt.enrich(s, c, 2, 19723, 20)) == plain(sales, changes, 2, 20)
    assert stores() <= opened and threads() <= running
