"""Nearest vectors in shelves of queries, against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from threadloom.operators import vectors


@pytest.mark.parametrize("shelf", [7, 10_000])
def test_cosine_top_k_in_shelves(spark, shelf, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (90, 4)).astype(float)  # many ties, some zero vectors
    m[5], m[6], m[7] = 0, m[4], 2 * m[4]
    asked = m[:40] + 0.5
    rows = [(2**62 + i, v.tolist()) for i, v in enumerate(m)] + [(1, None)]
    queries = [(2**61 + i, v.tolist()) for i, v in enumerate(asked)] + [(2, None)]
    got = vectors.cosine_top_k(spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(queries, "qid long, vector array<double>"), 5, shelf=shelf).collect()
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
    sims = np.round(unit(asked) @ unit(m).T, 6)
    want = {(2**61 + q, r + 1, 2**62 + int(i), float(row[i])) for q, row in enumerate(sims) for r, i in enumerate(np.lexsort((np.arange(len(m)), -row))[:5])}
    assert {(x["qid"], x["rank"], x["id"], x["sim"]) for x in got} == want and len(got) == 200


def test_no_rows(spark):
    some, none = spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"), spark.createDataFrame([], "id long, vector array<double>")
    asked = lambda df: df.withColumnRenamed("id", "qid")
    assert vectors.cosine_top_k(none, asked(some), 3).count() == 0 == vectors.cosine_top_k(some, asked(none), 3).count()
    assert [tuple(x) for x in vectors.cosine_top_k(some, asked(some), 3).select("qid", "id", "sim", "rank").collect()] == [(1, 1, 1.0, 1)]
