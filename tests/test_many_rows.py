"""Queries on tables whose keys hold more rows than the small ones have."""

from __future__ import annotations

import random
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from ravine.operators import structure
from ravine.plans import registry


def _sql(name: str, **tables: str) -> list[tuple]:
    db = duckdb.connect()
    for table, path in tables.items():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return sorted(db.execute(registry.ORACLES[name]).fetchall())


def test_headings_with_five_digits(spark, tmp_path):
    """a document with more than 10,000 headings."""
    n = 10_020
    html = [f"<h1>Heading number{i} of many</h1>" for i in range(n)]
    pq.write_table(pa.table({"page_id": pa.array([10 * i for i in range(n)], pa.int64()), "url": ["u"] * n, "html": html}), tmp_path / "pages.parquet")
    rows = registry.QUERIES["heading_extract"](spark, str(tmp_path)).select("doc_id", "idx", "text", "section_id", "level")
    got = sorted(tuple(r) for r in rows.collect())
    assert len(got) == n and got == _sql("heading_extract", pages=str(tmp_path / "pages.parquet"))


def _pairwise(bookmarks, headings):
    used, out = set(), []
    for b, bt in sorted(bookmarks):
        scored = []
        for h, ht in headings:
            if h not in used:
                score = 100 if bt == ht else 80 if bt in ht or ht in bt else 50 if any(len(w) > 3 and w in ht for w in bt.split()) else 0
                scored += [(-score, h)] * (score > 0)
        if scored:
            worst, h = min(scored)
            used.add(h)
            out.append((b, h, -worst))
    return out


def test_bookmarks_meet_few_headings():
    """equal to all pairs on small outlines, and a large one ends soon."""
    rng = random.Random(2)
    words = ["part", "a", "of", "control", "controls", "net", "networks", "", "parting", "x1"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4)))
    for _ in range(200):
        marks, heads = ([(i, title()) for i in range(rng.randrange(12))] for _ in range(2))
        assert structure.greedy_titles(marks, heads) == _pairwise(marks, heads)
    n = 20_000
    many = [(i, f"part number{i * 7919 % n} of the outline") for i in range(n)]
    start = time.process_time()
    out = structure.greedy_titles([(i, f"part number{i}") for i in range(n)], many)
    assert len({h for _, h, _ in out}) == n and time.process_time() - start < 60  # 400,000,000 pairs
