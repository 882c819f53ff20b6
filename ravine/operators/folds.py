"""Folds over a key's ordered rows: state of one key at a time, rows streamed through Arrow.

Rows are dealt by key and sorted; a task holds the open group of one key, so a key's rows are never
gathered. Used where the next state hangs on the last one and no window can express it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, key: str, order: list[str], step: Callable, schema: str) -> DataFrame:
    """``step(key)`` gives (push, done) for a key: push(row) and done() return finished rows.

    ``df``'s first column is the key; push gets the others. Rows out have the key first.
    """
    kinds = _schema(schema)
    names = [f.name for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, push, done, out = None, None, None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], names=names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if push is None or row[0] != here:
                    if done:
                        out += [(here, *r) for r in done()]
                    here = row[0]
                    push, done = step(here)
                out += [(here, *r) for r in push(row[1:])]
            if len(out) > 10_000:
                yield batch()
                out = []
        if done:
            out += [(here, *r) for r in done()]
        if out:
            yield batch()

    rest = [c for c in df.columns if c != key]
    return df.select(key, *rest).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def greedy_chunks(target: int, least: int):
    """Elements (page_no, idx, section_id, header, text) to chunks (chunk_no, page_no, section_id,
    n_elements, length, text).

    A header ends the open chunk; one that begins a section (``section_id``) begins the next chunk
    as its title. A chunk also ends when its section changes or its elements' lengths reach the
    target. What stays shorter than ``least`` is dropped and takes no number. A chunk's page is
    that where its buffer began: after a full chunk, the page that filled it.
    """

    def step(_key):
        state = {"parts": [], "page": None, "of": None, "section": None, "n": 0}

        def flush():
            text, s = " ".join(state["parts"]).strip(), state
            n, s["parts"] = len(s["parts"]), []
            if len(text) < least:
                return []
            s["n"] += 1
            return [(s["n"] - 1, s["page"], s["of"], n, len(text), text)]

        def push(row):
            page, _, section, header, text = row
            s = state
            if s["page"] is None:
                s["page"] = page
            if s["section"] is None and not header:
                s["section"] = section
            if s["of"] is None:
                s["of"] = s["section"]
            if header:
                out = flush()
                if section is not None:
                    s.update(section=section, of=section, page=page, parts=["## " + text])
                return out
            out = []
            if s["of"] != s["section"]:
                out = flush()
                s.update(of=s["section"], page=page)
            s["parts"].append(text)
            if sum(map(len, s["parts"])) >= target:
                out += flush()
                s["page"] = page
            return out

        return push, flush

    return step


def transcript_chunks(seconds: int):
    """Segments (at, seq, duration, text) to chunks (chunk_no, start_s, end_s, n, text): a chunk ends
    before the segment that would make it longer than ``seconds``."""

    def step(_key):
        state = {"rows": [], "total": 0, "n": -1}

        def flush():
            rows = state["rows"]
            if not rows:
                return []
            state["n"] += 1
            state["rows"], state["total"] = [], 0
            return [(state["n"], rows[0][0], rows[-1][0] + rows[-1][2], len(rows), " ".join(r[3] for r in rows if r[3] is not None))]

        def push(row):
            out = flush() if state["rows"] and state["total"] + row[2] > seconds else []
            state["rows"].append(row)
            state["total"] += row[2]
            return out

        return push, flush

    return step


def spaced(gap: float):
    """Times (at,) to those more than ``gap`` after the last one kept."""

    def step(_key):
        last = []

        def push(row):
            if last and row[0] - last[0] <= gap:
                return []
            last[:] = [row[0]]
            return [(row[0],)]

        return push, lambda: []

    return step
