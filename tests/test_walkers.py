"""Random walkers meet one neighbour a step."""

from __future__ import annotations

from threadloom.operators import diffusion, graph


def test_walkers_never_meet_a_hub_s_list(spark):
    edges = spark.createDataFrame([(1, "hub", f"l{i}") for i in range(300)], "qid long, src string, dst string")
    plans = []
    settle = lambda df: plans.append(df._jdf.queryExecution().toString()) or diffusion.cut(df)
    got = diffusion.random_walks(graph.both_ways(edges, ("qid",)), spark.createDataFrame([(1, "hub"), (1, "gone")], "qid long, source string"), walks=64, steps=6, settle=settle).collect()
    assert plans and not any("collect_list" in p for p in plans)
    assert abs(sum(r["score"] for r in got if r["source"] == "hub") - 1) < 1e-9
    assert [(r["node"], r["score"]) for r in got if r["source"] == "gone"] == [("gone", 1.0)]
