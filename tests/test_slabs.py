"""Walks of many starts over one packed graph with two sides, held against power iteration."""

from __future__ import annotations

import random

import numpy as np
import pytest

from threadloom.operators import graph, slabs


def brute(lists, start, alpha=0.15, steps=400):
    """Power iteration over a dense matrix."""
    lists = {u: v for u, v in lists.items() if v}
    names = sorted({*lists, *(e for v in lists.values() for e in v)})
    at = {n: i for i, n in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for u, v in lists.items():
        for e in v:
            a[at[u], at[e]] = a[at[e], at[u]] = 1
    s = np.zeros(len(names))
    for n, m in start.items():
        s[at[n]] += m
    x = s
    for _ in range(steps):
        x = alpha * s + (1 - alpha) * (a / a.sum(0)) @ x
    return dict(zip(names, x, strict=True))


def packed(spark, lists, most):
    return slabs.slabs(spark.createDataFrame(list(lists.items()), "node string, linked array<string>"), most).localCheckpoint()


@pytest.mark.parametrize("most,room", [(2_000_000, 1 << 29), (40, 0)])
def test_walks_equal_power_iteration(spark, most, room):
    """Many small slabs and one, arrays in memory and in a file, lists longer than a run, hubs, pieces that no start reaches, ids of any size."""
    r = random.Random(3)
    lists = {f"c::{i}": sorted({"e::hub", *(f"e::{int(r.expovariate(0.05))}" for _ in range(r.randint(1, 9)))}) for i in range(150)}
    lists |= {"c::long": [f"e::l{i}" for i in range(150)] + ["e::1"], "c::far": ["e::far", "e::away"], "c::bare": []}
    starts = {q: {f"e::{q}": 0.75, "e::l7": 0.25} for q in range(19)} | {2**62 + 1: {"e::far": 1.0}, 77: {"e::hub": 3.0}}
    rows = [(q, n, m) for q, s in starts.items() for n, m in s.items()] + [(5, "e::nowhere", 9.0), (6_000, "e::nowhere", 1.0)]
    restart = spark.createDataFrame(rows, "qid long, node string, mass double")
    held = packed(spark, lists, most)
    got = {}
    for x in slabs.walk(held, restart, tolerance=1e-9, room=room).collect():
        assert (x["qid"], x["node"]) not in got
        got[x["qid"], x["node"]] = x["mass"]
    assert {q for q, _ in got} == set(starts)
    for q, s in starts.items():
        want = brute(lists, {n: m for n, m in s.items() if any(n in v for v in lists.values())})
        assert all(abs(m - got.get((q, n), 0.0)) <= 2e-9 for n, m in want.items())
    assert {n for q, n in got if q == 2**62 + 1} == {"c::far", "e::far", "e::away"}


def test_the_heaviest_and_their_ties(spark):
    """With a number of rows asked for, those are there and all that round to the last one's value, and nothing that is lighter."""
    lists = {f"c::{i}": ["e::mid", f"e::{i}"] for i in range(30)}
    held = packed(spark, lists, 7)
    want = brute(lists, {"e::mid": 1.0})
    for most, kept in ((1, 1), (2, 31), (31, 31), (32, 61), (100, 61)):
        got = {x["node"] for x in slabs.walk(held, spark.createDataFrame([(1, "e::mid", 1.0)], "qid long, node string, mass double"), most).collect()}
        assert len(got) == kept and got == set(sorted(want, key=lambda n: (-round(want[n], 8), n))[:kept])
    assert slabs.walk(held.limit(0), spark.createDataFrame([(1, "e::mid", 1.0)], "qid long, node string, mass double")).count() == 0
    assert slabs.walk(held, spark.createDataFrame([], "qid long, node string, mass double")).count() == 0


def test_diffusion_of_documents_without_an_id(spark):
    """Rows of one document are one, and those without an id are no nodes: no mass goes there (their neighbours' share was lost)."""
    from threadloom.plans import queries
    from threadloom.plans.binding import Retrieval

    rows = [(1, "Amber Falls lies near Birch Town."), (1, "Birch Town trades with Cedar Port."), (None, "Cedar Port ships amber to Delta City."), (4, "Delta City hosts the Elm Fair at Cedar Port.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = Retrieval(spark.createDataFrame([(8, "Who hosts the Elm Fair near Cedar Port?")], "qid long, text string"), docs)
    lists: dict[str, set] = {}
    for e in graph.corpus_graph(docs.filter("doc_id is not null")).collect():
        lists.setdefault(e["src"], set()).add(e["dst"])
    assert sorted(lists) == ["c::1:0", "c::4:0"]
    asked = [x["node"] for x in r.corpus_sources.collect()]
    want = brute(lists, dict.fromkeys(asked, 1 / len(asked)))
    got = {x["node"]: x["mass"] for x in queries.corpus_diffusion(r).collect()}
    assert asked and len(got) == min(20, len(want)) and all(abs(m - want[n]) < 1e-4 for n, m in got.items())
    assert abs(sum(want.values()) - 1) < 1e-9
