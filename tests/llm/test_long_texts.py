"""Texts of more than a megabyte through the operators and every stage, with columns whose names clash."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ravine.llm import mixing, nbsvm, quality, sharding, simhash, templates, warc

ITEM = "Which river passes the old mill of Tarnel before it meets the sea near Quorvane bay"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    one, other = words(190_000), words(190_000)
    plain = {
        1: " ".join(one),
        2: " ".join(one),  # a copy
        3: " ".join([*other[:90_000], ITEM, *other[90_000:]]),
        4: " ".join([*one[:-3], "x", "y", "z"]),  # nearly a copy
    }
    return plain | {10 + i: " ".join(words(40)) for i in range(30)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s1", len(t), "clash", 7) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, size int").repartition(4)


def test_operators(spark, docs, texts):
    assert len(texts[1]) > 1 << 20
    n = {i: len(t.split()) for i, t in texts.items()}
    for r in sharding.shard_documents(docs).collect():
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id].encode()))
    assert {r.doc_id: r["size"] for r in mixing.mix_documents(docs).collect()} == n
    prints = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicate_documents(docs).collect()}
    assert prints[1] == prints[2] and prints[2][1] == 1 and prints[3][1] == 3 and prints[4][1] == 1
    for r in quality.judge_documents(docs).collect():
        assert (r.n_words, r.word_chars) == (n[r.doc_id], sum(map(len, texts[r.doc_id].split()))) and not r.base_failed
    bench = spark.createDataFrame([(5, ITEM)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in templates.leaked_documents(docs, bench).collect()} == {(3, 5)}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in texts], "doc_id bigint, quality int, toxic int")
    scores = {r.doc_id: r.score for r in nbsvm.score_documents(docs, labels).collect()}
    assert scores.keys() == texts.keys() and all(0 <= x <= 1 for x in scores.values()) and scores[1] == scores[2]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "node")
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    assert all(got[i].payload_bytes == len(t) and got[i].payload_digest == warc.base32_sha1(t.encode()) for i, t in texts.items())
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")


def test_stages(spark, docs, texts, tmp_path):
    spark.createDataFrame([(5, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        left[name] = {r[0] for r in now.select("doc_id").collect()}
        if name != "sharding":
            assert now.columns == corpus_pipeline.COLUMNS
            now = now.withColumns({"node": F.lit("clash"), "size": F.lit(1), "slot": F.lit("x"), "position": F.lit(None).cast("string")})
    assert left["quality_rules"] == texts.keys()
    assert left["simhash_near_dedup"] == texts.keys() - {2, 4}
    assert left["benchmark_decontamination"] == texts.keys() - {2, 3, 4}
    assert left["mixing_sources"] <= left["benchmark_decontamination"] and left["sharding"] == left["mixing_sources"]
    for r in now.select("doc_id", F.md5("text").alias("m"), "shard", "slot").collect():
        assert r["m"] == hashlib.md5(texts[r["doc_id"]].encode()).hexdigest() and 0 <= r["shard"] < 16
