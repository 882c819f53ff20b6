"""Whitening against numpy and exact fractions; the eigen-solve on hard matrices."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from ravine.llm import whitening as w

SCHEMA = "vec_id bigint, embedding array<float>, x string, y string"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["full", "same", "none", "low", "close"])
def test_eigen(n, kind):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    a = {"full": a @ a.T, "same": 3 * np.eye(n), "none": np.zeros((n, n)), "low": a[:, : n // 3 + 1] @ a[:, : n // 3 + 1].T, "close": np.eye(n) + 1e-13 * (a + a.T)}[kind]
    e, v = w.eigen(a)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * scale * n
    assert np.abs(v @ v.T - np.eye(n)).max() < 1e-13
    assert np.abs(v @ a - e[:, None] * v).max() <= 1e-13 * scale * n


def test_products_lose_nothing():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=50) * 10.0 ** rng.integers(-9, 9, 50), rng.normal(size=50)
    p, e = w.two_product(a, b)
    assert all(Fraction(x) * Fraction(y) == Fraction(h) + Fraction(f) for x, y, h, f in zip(a, b, p, e))
    h, low = w.fold(np.array([1e16, 1.0, -1e16, 1e-8]), np.zeros(4))
    assert h == 1 + 1e-8 and abs(low) < 1e-16


def rows_of(spark, rows, parts=4):
    return w.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts))


def test_against_fractions_and_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 9)) @ np.diag([4, 3, 2, 1.5, 1, 1, 0.5, 0.5, 0.2]) + 100).astype(np.float32)
    vectors[40:140] = vectors[3]
    rows = [(i, v.tolist(), "x", "y") for i, v in enumerate(vectors)] + [(900, None, "", ""), (901, [1.0, None] + [0.0] * 7, "", ""), (902, [float("nan")] * 9, "", ""), (903, [float("inf")] * 9, "", ""), (904, [], "", ""), (905, [1.0], "", ""), (None, vectors[5].tolist(), "", "")]
    got = rows_of(spark, rows).collect()
    x = np.floor(256 * vectors.astype(float)).astype(int)
    fit = [*{tuple(r) for r in x.tolist()}]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    c = [[Fraction(a) - Fraction(b, n) for a, b in zip(r, s)] for r in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in c) / n) for j in range(9)] for i in range(9)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == 4 * 301 and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert 0 <= got[0]["identity_error"] < 1e-10
    for k in range(4):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        y = (x - np.array(s) / n) @ q[:, k] / np.sqrt(e[k])
        sign = np.sign(mine[0]["whitened"] * y[0])
        for i in range(300):
            assert abs(sign * mine[i]["whitened"] - y[i]) < 1e-9
            assert mine[i]["deviation"] == sum((n * int(a) - b) ** 2 for a, b in zip(x[i], s))
            assert abs(mine[i]["explained"] - e[k] / np.trace(v)) < 1e-12
        assert mine[None]["whitened"] == mine[5]["whitened"]


def test_nothing_to_scale(spark):
    assert rows_of(spark, []).count() == 0
    assert rows_of(spark, [(1, None, "", "")]).count() == 0
    one = rows_of(spark, [(1, [0.5, -0.0, 2.0], "", "")]).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)]
    flat = rows_of(spark, [(i, [float(i), 7.0], "", "") for i in range(5)]).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert flat[0]["identity_error"] < 1e-12 and {r["explained"] for r in flat if r["component"] == 1} == {1.0}


def test_parts_of_a_large_triangle(spark, monkeypatch):
    monkeypatch.setattr(w, "BLOCK", 7)
    monkeypatch.setattr(w, "AT_ONCE", 20)
    rng = np.random.default_rng(5)
    x = rng.integers(-999, 999, size=(60, 6))
    high, low = w.second_moments(spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>").repartition(3), 6, (np.full(6, 0.5), np.zeros(6)))
    assert (high + low == (x - 0.5).T @ (x - 0.5)).all()
