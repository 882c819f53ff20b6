"""The automaton against plain substring search."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ravine.functions import keywords

RULES = {"one": ["ab", "abc", "b c"], "two": ["bca", "aa"], "three": ["ab", "zz"]}


def test_labels_and_counts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc zü", k=rng.randrange(30))) for _ in range(400)] + ["", None, "a" * 7, "ab" * 500_000]
    words = ["aa", "ab", "aba", "zz", "ab", "nowhere"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    got = {r["id"]: r for r in df.select("id", keywords.labels(F.col("text"), RULES, "none").alias("l"), keywords.counts(F.col("text"), words).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["l"] == ([k for k, ws in RULES.items() if t and any(w in t for w in ws)] or ["none"])
        assert got[i]["n"] == (None if t is None else [t.count(w) for w in words])
