"""Connected components against union-find, and the rounds that they take."""

from __future__ import annotations

import random

from threadloom.llm import common, near


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {x: find(x) for x in parent if any(x in e for e in edges)}


def found(spark, edges):
    rows = near.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["root"] for r in rows}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(40)]
    rng.shuffle(path)
    cases = [path, [(0, 1), (1, 2), (2, 0), (9, 8), (8, 9)], [(9, 1), (9, 2), (9, 3)], [(rng.randrange(60), 100 + rng.randrange(60)) for _ in range(60)]]
    for edges in cases:
        assert found(spark, edges) == roots(edges)
    assert found(spark, [(4, 4)]) == {}


def test_stars_take_no_round_and_a_last_one_is_not_repeated(spark, monkeypatch):
    cuts, durable = [], common.durable
    monkeypatch.setattr(common, "durable", lambda df: cuts.append(1) or durable(df))
    star = [(1, k) for k in range(2, 9)]
    assert found(spark, star) == roots(star) and len(cuts) == 1
    cuts.clear()
    hung = [(9, k) for k in range(1, 5)]
    assert found(spark, hung) == roots(hung) and len(cuts) == 2
