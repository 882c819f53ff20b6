"""Table functions give what the Python calls give."""

from __future__ import annotations

import random

from ravine.operators import search
from ravine.sources import functions


def test_calls_agree(spark):
    rng = random.Random(4)
    topics = ["graphics", "hardware", "other"]
    rows = [(i, rng.choice("ab"), " ".join(rng.choices(["that", "with", "x"], k=5)), 1, None, rng.choice(topics), rng.sample(topics, 2), [rng.random() for _ in range(rng.choice([4, 4, 4, 3]))] if i % 7 else None) for i in range(80)]
    rows += [(100, "a", "", 1, None, None, None, [0.0] * 4), (101, None, None, None, None, None, None, [1.0, 0.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "id bigint, doc_id string, content string, page_number int, section_id string, topic string, topics array<string>, embedding array<float>")
    functions.register(chunks, "some_chunks")
    q = "array(0.5D, 0.25D, 0.1D, 0.7D)"
    vec = [0.5, 0.25, 0.1, 0.7]
    got = [tuple(r) for r in spark.sql(f"SELECT * FROM search_chunks(query_embedding => {q}, k => 5)").collect()]
    assert got == [(r["id"], r["similarity"]) for r in search.vector_search(chunks, vec, k=5).collect()]
    for include, exclude in ((["graphics", "hardware"], []), (None, ["hardware"])):
        call = f"query_embedding => {q}, terms => array('that', 'with')" + (", include_topics => array('graphics', 'hardware')" if include else "") + (", exclude_topics => array('hardware')" if exclude else "")
        got = sorted(tuple(r) for r in spark.sql(f"SELECT * FROM search_chunks_hybrid_with_topics({call}, k => 6)").collect())
        want = search.hybrid_topics(chunks, vec, ["that", "with"], include, exclude, k=6).select("id", "semantic_score", "keyword_score", "topic_boost", "final_score").collect()
        assert got == sorted(tuple(r) for r in want)
