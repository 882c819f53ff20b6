"""Neighbours across buckets against a loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ravine.operators import expand


@pytest.mark.parametrize("buckets", [1, 7, 60])
def test_neighbours(spark, buckets):
    rng = random.Random(buckets)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, rng.choice([f"v{i}", f"v{i}", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id string, id bigint, text string").repartition(5)
    got = {r["id"]: (r["doc_id"], r["before"], r["after"]) for r in expand.neighbours(df, F.col("text"), 3, buckets=buckets).collect()}
    want = {}
    for doc in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == doc]
        for k, (_, i, _) in enumerate(own):
            want[i] = (doc, [r[2] for r in own[max(0, k - 3) : k] if r[2] is not None], [r[2] for r in own[k + 1 : k + 4] if r[2] is not None])
    assert got == want


def test_no_rows(spark):
    assert expand.neighbours(spark.createDataFrame([], "doc_id string, id bigint, text string"), F.col("text")).count() == 0


def test_numbered(spark):
    rows = [(i * 7 % 5, i) for i in range(83)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    for parts in (1, 4, 100):
        got = {(r["a"], r["b"]): r["place"] for r in expand.numbered(df, ["a", F.desc("b")], parts=parts).collect()}
        assert got == {r: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0], -r[1])), 1)}
