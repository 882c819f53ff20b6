"""The list index: recall, exactness, pruned files, odd vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ravine.operators import search, vector_index as vi

SCHEMA = "id bigint, embedding array<float>"


def made(n=900, d=12, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(15, d))
    return (centers[rng.integers(0, 15, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)


def truth(x, asked, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    out = {}
    for q in asked:
        s = np.round(u @ u[q], 6)
        out[q] = np.lexsort((np.arange(len(x)), -s))[:k].tolist()
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_index(spark, tmp_path):
    x = made()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 12), (5002, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    index = vi.build(df, str(tmp_path / "ix"), lists=20)
    assert index.rows.count() == len(rows) + 2  # every row with a vector is filed
    assert index.probes < 20 and index.recall[index.probes - 1] >= vi.TARGET and index.recall[-1] == 1.0
    asked = list(range(0, 900, 50))
    queries = spark.createDataFrame([(q, x[q].tolist()) for q in asked] + [(7000, None), (7001, [0.0] * 12)], "query_id bigint, embedding array<float>")
    want = truth(x, asked, 10)
    assert found(index.batch(queries, 10, probes=20)) == want
    assert found(search.batch_vector_search(df, queries, 10)) == want
    near = found(index.batch(queries, 10))
    assert np.mean([len(set(near[q]) & set(want[q])) / 10 for q in asked]) >= 0.9
    again = vi.load(spark, str(tmp_path / "ix"))
    assert (again.centroids == index.centroids).all() and again.probes == index.probes
    one = again.search(x[3].tolist(), 10, probes=3)
    assert len(one.inputFiles()) > len(again.lists(x[3].tolist(), 3))  # all files are listed ...
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("#", " #").replace("[list #", "[list") or "list" in plan.split("PartitionFilters:")[1][:40]  # ... those of other lists aren't read
    assert [r["id"] for r in again.exact(x[3].tolist(), 10).collect()] == truth(x, [3], 10)[3]


def test_hot_vector_and_small_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, 0.0, 0.0] if i % 3 else [float(i), 1.0, 2.0]) for i in range(300)], SCHEMA)
    index = vi.build(df, str(tmp_path / "hot"), lists=6)
    queries = df.filter("id % 50 = 0").selectExpr("id as query_id", "embedding")
    assert found(index.batch(queries, 3, probes=6)) == found(search.batch_vector_search(df, queries, 3, block=2))
    single = vi.build(df.limit(1), str(tmp_path / "one"))
    assert single.batch(queries, 3).select("id").distinct().count() == 1


def test_a_block_takes_little_memory():
    """F4, F5, F7, F8, F11: a full block of rows and queries, and queries under all lists."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rows, queries = vi.ROWS, vi.QUERIES
    x = np.repeat(rng.normal(size=(rows // 4, 8)), 4, axis=0).astype(np.float32)  # each vector four times
    q = rng.normal(size=(queries, 8)).astype(np.float32)
    flat = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 8).cast(pa.list_(pa.float32()))
    ids = rng.permutation(rows)
    left, right = pa.table({"id": ids, "embedding": flat(x)}), pa.table({"query_id": np.arange(queries), "embedding": flat(q)})
    tracemalloc.start()
    out = vi._best(6)(left, right)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(queries)), flat(q)], ["query_id", "embedding"])
    assert sum(b.num_rows for b in vi._assigned(iter([batch]), q[:512].astype(np.float64), 512)) == queries * 512
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    at = np.random.default_rng(4).integers(0, queries, 20)
    cosine = np.round((q @ x.T.astype(np.float64)) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x.astype(np.float64), axis=1), 6)
    got = out.to_pandas().groupby("query_id")["id"].apply(list)
    for i in at:
        assert got[i] == ids[np.lexsort((ids, -cosine[i]))[:6]].tolist()
