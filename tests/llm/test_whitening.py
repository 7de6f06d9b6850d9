"""Whitening against numpy over all rows."""

from __future__ import annotations

import numpy as np
import pytest

from threadloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n int"


def brute(vectors, components=4):
    kept = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max(len(vectors[i]) for i in kept)
    x = np.zeros((len(kept), dims), np.int64)
    for row, i in zip(x, kept, strict=True):
        row[: len(vectors[i])] = np.floor(256 * np.asarray(vectors[i], float)).astype(np.int64)
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(0)
    c = (n * distinct - s) / n
    v = c.T @ c / n
    e, axes = (a[..., ::-1] for a in np.linalg.eigh(v))
    k = min(components, dims)
    return kept, n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ (axes[:, :k] / np.sqrt(e[:k])), e[:k] / np.trace(v)


def check(rows, vectors, components=4):
    kept, n, deviation, white, explained = brute(vectors, components)
    k = white.shape[1]
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, c) for i in kept for c in range(1, k + 1))
    at = {i: p for p, i in enumerate(kept)}
    sign = np.zeros(k)
    for r in rows:
        p, c = at[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[p])
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-9
        if abs(white[p, c]) > 1e-6:
            sign[c] = sign[c] or np.sign(white[p, c] * r["whitened"])
            assert r["whitened"] == pytest.approx(sign[c] * white[p, c], abs=1e-7)


@pytest.mark.parametrize("w", [whitening.Whitening(), whitening.Whitening(tile=3, rows=7)])
def test_whitening_against_numpy(spark, w):
    rng = np.random.default_rng(3)
    turn = rng.normal(size=(10, 10))
    vectors = [list(map(float, v)) for v in rng.normal(size=(200, 10)) @ turn]
    vectors += [vectors[0]] * 50 + [None, [None] * 10, [float("nan")] + [0.0] * 9, [float("inf")] + [0.0] * 9, vectors[3][:7]]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    check(whitening.whiten(df, w).collect(), vectors)


def test_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    vectors = [None] * (1 + max(r["vec_id"] for r in rows))
    for r in rows:
        vectors[r["vec_id"]] = r["embedding"]
    check(whitening.op12_whitening(spark, "/root/testdata/sf0.001").collect(), vectors)


def test_few_rows_and_no_variance(spark):
    make = lambda *v: spark.createDataFrame([(i, x, 0, "x", 0) for i, x in enumerate(v)], SCHEMA)
    assert whitening.whiten(make()).collect() == []
    assert whitening.whiten(make(None, [float("nan")])).collect() == []
    same = whitening.whiten(make([1.0, 2.0], [1.0, 2.0])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(same, key=lambda r: (r["vec_id"], r["component"]))] == [(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (0, 1) for c in (1, 2)]
    flat = whitening.whiten(make([0.0, 1.0], [2.0, 1.0], [-2.0, 1.0])).collect()
    assert {(r["component"], r["whitened"] == 0) for r in flat if r["vec_id"] == 1} == {(1, False), (2, True)}


def test_large_sums_stay_exact():
    sums = np.asarray([2**60, -(2**60)], object)
    m = np.asarray([[2**50, -3], [1, 2]], np.int64)
    assert whitening.centred(m, 2**20, sums).tolist() == [[2**70 - 2**60, -3 * 2**20 + 2**60], [2**20 - 2**60, 2**21 + 2**60]]
