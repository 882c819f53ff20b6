"""The set-similarity join against all pairs."""

from __future__ import annotations

import random

from ravine.operators import trigram


def grams(t):
    p = "  " + t.lower() + " "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def alike(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_against_all_pairs(spark):
    rng = random.Random(2)
    words = ["Alpha", "alphabet", "beta", "Gamma", "ga", "x", "delta wing", "wing"]
    titles = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 5))), rng.choice(["completed", "completed", "processing"]), rng.choice(['["wing","q"]', "[]", None, "no json"])) for i in range(200)]
    titles += [(300 + i, "the same title", "completed", None) for i in range(60)] + [(400, None, "completed", '["wing"]'), (401, "", "completed", None)]
    queries = [(0, "alpha beta"), (1, "wing"), (2, "ga"), (3, "x"), (4, ""), (5, None), (6, "THE SAME"), (7, "nothing like it"), (8, "wing"), (9, "q")]
    docs = spark.createDataFrame(titles, "id bigint, title string, status string, tags string").repartition(3)
    got = {}
    for r in trigram.search_documents(docs, spark.createDataFrame(queries, "query_id bigint, query string"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["similarity"]))
    for qid, q in queries:
        want = []
        for i, t, status, tags in titles:
            if q is None or t is None or status != "completed":
                continue
            s = round(alike(t, q), 6)
            if s > 0.3 or q and q.lower() in t.lower() or tags and tags.startswith("[") and f'"{q}"' in tags:
                want.append((-s, i))
        want = [(n, i, -s) for n, (s, i) in enumerate(sorted(want)[:10], 1)]
        if q == "":  # every title holds the empty query; only the similar ones are listed
            want = [w for w in want if w[2] > 0.3]
            assert sorted(got.get(qid, []))[: len(want)] == want
        else:
            assert sorted(got.get(qid, [])) == want, q
