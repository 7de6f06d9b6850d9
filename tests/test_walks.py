"""Walks and distances within a question's task against those by joins."""

from __future__ import annotations

from threadloom.operators import diffusion, graph
from threadloom.plans.binding import Retrieval

LINE, STAR = [(f"p{i}", f"p{i + 1}") for i in range(7)], [("c", f"l{i}") for i in range(5)]


def tables(spark):
    """A line and a star, two runs each, one of them cut, and a start without edges."""
    edges = [(1, 0, a, b) for a, b in LINE] + [(1, 1, a, b) for a, b in LINE if a != "p3"] + [(2, r, b, a) for r in (0, 1) for a, b in STAR] + [(2, 0, "c", "l0")]
    starts = [(q, r, s) for q, ss in ((1, ("p0", "p6")), (2, ("l0", "alone")), (3, ("bare",))) for r in (0, 1) for s in ss]
    return spark.createDataFrame(edges, "qid long, run int, src string, dst string"), diffusion.restart_vector(spark.createDataFrame(starts, "qid long, run int, source string"))


def test_page_rank_of_small_and_large_graphs(spark):
    edges, start = tables(spark)
    both = graph.both_ways(edges, ("qid", "run"))
    for steps, tolerance in ((5, None), (100, 1e-3)):
        want = {(r["qid"], r["run"], r["node"]): r["mass"] for r in diffusion.page_rank(both, start, steps, tolerance=tolerance).collect()}
        for most in (100, 5, 0):
            got = {(r["qid"], r["run"], r["node"]): r["mass"] for r in diffusion.graph_page_rank(edges, start, steps, tolerance=tolerance, most=most).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_distances_in_small_and_large_graphs(spark):
    edges, start = tables(spark)
    edges, sources = edges.filter("run = 0").select("qid", "src", "dst"), start.select("qid", "node").withColumnRenamed("node", "source").distinct()
    want = {tuple(r) for r in diffusion.distances(graph.both_ways(edges, ("qid",)), sources, 4).collect()}
    ends = {(r["qid"], r["source"]) for r in sources.collect()}
    for most in (100, 6, 0):
        assert {tuple(r) for r in diffusion.graph_distances(edges, sources, 4, most=most).collect()} == want
        assert {tuple(r) for r in diffusion.graph_distances(edges, sources, 4, among=True, most=most).collect()} == {x for x in want if (x[0], x[2]) in ends}


def test_a_question_s_walks_are_not_joined_step_by_step(spark):
    questions = spark.createDataFrame([(1, "red fox"), (2, "blue whale")], "qid long, text string")
    docs = spark.createDataFrame([(i, f"The red fox number{i} met a blue whale. The fox swam after whale{i}.") for i in range(6)], "doc_id long, text string")
    r = Retrieval(questions, docs)
    joined = []
    known, diffusion.page_rank = diffusion.page_rank, lambda *a, **k: joined.append(a) or known(*a, **k)
    try:
        assert r.mass.count() and r.seed_distances.count() and not joined
    finally:
        diffusion.page_rank = known
