"""Settings reach the stages: each one changes what comes out. Ids of questions stay whole, whatever their size."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from threadloom.functions import config
from threadloom.operators import anchors as A
from threadloom.operators import diffusion as D
from threadloom.operators import seeds as S
from threadloom.plans import binding, runs

BIG = [2**53 + 1, 2**62 + 3, 6917529027641081856, -5]
TEXTS = [
    "Lyon lies on the Rhone. The Rhone ends at the Mediterranean. Boats go there. Lyon has many bridges.",
    "Marie Curie was a physicist. She lived in Paris. Paris lies on the Seine. Physicists met in Lyon.",
    "The Rhone rises in a glacier. Glaciers melt. The Mediterranean is warm. Lyon is old.",
]


@pytest.fixture(scope="module")
def base(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string")
    asked = spark.createDataFrame([(q, "Where does the Rhone of Lyon end, the Mediterranean of Paris?") for q in BIG], "qid long, text string")
    r = runs.bound(asked, docs, config.settings(overrides={"method": "naive"}))
    r.limits = replace(r.limits, steps=8, tolerance=None)
    return r


def changed(base, *shared, **limits):
    r = binding.Retrieval(base.questions, base.docs, base.shaping, replace(base.limits, **limits))
    for stage in shared:
        vars(r)[stage] = getattr(base, stage)
    return r


GRAPH = ("tokens", "support", "anchors", "hits", "contexts", "edges", "adjacent", "degree", "sources", "sentences", "similarity", "unit_tokens", "anchor_similarity", "mentions", "grounding")
WALKED = (*GRAPH, "distances", "run_edges", "mass")
CHOSEN = (*WALKED, "candidates", "components", "seed_scores", "seed_distances", "seeds", "runs")


def test_settings_are_the_limits():
    values = config.settings(overrides={"tau": 3, "samples_per_anchor": 5, "candidate_top_t": 9, "seed_k": 2, "max_anchors": 1, "pair_shortlist_topb": 7, "phase1_run_preshortlist_topm": 4, "phase1_full_run_score_topk": 3, "retrieval_objective_mode": "run_objective_role_balanced"})
    got = binding.Limits.of(values, stable=True)
    assert (got.tau, got.runs, got.candidates, got.seeds, got.anchors, got.pairs, got.light_runs, got.full_runs) == (3, 5, 9, 2, 1, 7, 4, 3)
    assert (got.steps, got.tolerance, got.stable, got.trim) == (100, 1e-6, True, False)
    assert got.run_weights["pair_coverage"] == 0.08 and got.seed_coverage == 0.20 and "seed_bridge" not in got.run_weights


def test_ids_of_questions_survive(base):
    for stage in (base.mass, base.seeds, base.selected):
        assert {r["qid"] for r in stage.select("qid").distinct().collect()} == set(BIG)
    total = base.mass.groupBy("qid", "run").agg(F.sum("mass").alias("m")).collect()
    assert len(total) == 3 * len(BIG) and all(abs(r["m"] - 1) < 1e-9 for r in total)


def most(df, *by):
    return df.groupBy(*by).count().agg(F.max("count")).first()[0]


def test_each_setting_changes_its_stage(base):
    assert most(base.anchors, "qid") > 1 == most(changed(base, "tokens", "support", anchors=1).anchors, "qid")
    assert most(changed(base, "tokens", "support", "anchors", documents=1).hits, "qid") == 1 < most(base.hits, "qid")
    assert changed(base, *GRAPH, tau=1).distances.agg(F.max("dist")).first()[0] == 1 < base.distances.agg(F.max("dist")).first()[0]
    assert changed(base, *GRAPH, "distances", runs=1, steps=1).mass.select("run").distinct().count() == 1 < base.mass.select("run").distinct().count()
    assert most(changed(base, *WALKED, candidates=3).candidates, "qid", "run") == 3 < most(base.candidates, "qid", "run")
    assert most(changed(base, *CHOSEN[:-2], seeds=1).seeds, "qid", "run") == 1 < most(base.seeds, "qid", "run")
    assert most(changed(base, *CHOSEN, pairs=2).pairs, "qid") == 2 < most(base.pairs, "qid")
    weighted = changed(base, *CHOSEN[:-1], run_weights={"dispersion": 1.0}).runs
    assert {r["run_score"] for r in weighted.collect()} != {r["run_score"] for r in base.runs.collect()}
    bridged = changed(base, *CHOSEN[:-4], seed_bridge=5.0).seed_scores
    assert {r["weight"] for r in bridged.collect()} != {r["weight"] for r in base.seed_scores.collect()}


def test_methods_differ_in_run_choice_and_trim(base):
    made = runs.variants(base.questions, base.docs, base)
    one = made["main"]
    best = {(r["qid"], r["run"]) for r in one.chosen.collect()}
    assert len(best) == len(BIG)
    assert {(r["qid"], r["run"]) for r in one.pairs.select("qid", "run").distinct().collect()} <= best
    assert one.run_edges is base.run_edges
    nodes = {m: {(r["qid"], r["node"]) for r in v.selected.collect()} for m, v in made.items()}
    assert nodes["main"] <= nodes["main_untrimmed"] and nodes["naive"]


def test_run_score_by_weights(spark):
    row = spark.createDataFrame([(1, 0, 0.8, 0.4, 0.2, 0.6, 0.5, 0.3)], "qid long, run int, semantic double, anchor double, structure double, bridge double, redundancy double, dispersion double")
    assert S.run_score(row).first()["run_score"] == pytest.approx(0.30 * 0.8 + 0.20 * 0.4 + 0.25 * 0.2 + 0.15 * 0.6 - 0.10 * 0.5)
    assert S.run_score(row, {"semantic": 1.0, "dispersion": 1.0, "bridge": -3.0}).first()["run_score"] == pytest.approx((0.8 - 0.3) / 2)


def test_page_rank_of_a_node_that_lost_its_edges(spark):
    edges = spark.createDataFrame([(1, 0, "a", "b"), (1, 0, "b", "a"), (1, 1, "b", "c"), (1, 1, "c", "b")], "qid long, run int, src string, dst string")
    start = D.restart_vector(spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 1, "b")], "qid long, run int, source string"))
    got = {(r["run"], r["node"]): r["mass"] for r in D.page_rank(edges, start, 60).collect()}
    a = 0.15 / (1 - 0.85**2)
    assert got[0, "a"] == pytest.approx(a, abs=1e-4) and got[0, "b"] == pytest.approx(0.85 * a, abs=1e-4)
    # run 1: a is cut off, its mass goes back to a and b
    x, y, z = got[1, "a"], got[1, "b"], got[1, "c"]
    assert x == pytest.approx(0.5 * (0.15 + 0.85 * x), abs=1e-4) and y == pytest.approx(0.5 * (0.15 + 0.85 * x) + 0.85 * z, abs=1e-4) and z == pytest.approx(0.85 * y, abs=1e-4)


def test_reduced_graph_holds_all_shortest_paths(spark):
    links = [("a", "p"), ("a", "q"), ("p", "t"), ("q", "t"), ("t", "u"), ("a", "z"), ("u", "r::1"), ("r::1", "z")]
    adjacent = spark.createDataFrame([(1, *e) for e in links] + [(1, y, x) for x, y in links], "qid long, src string, dst string").cache()
    sources = spark.createDataFrame([(1, "a")], "qid long, source string")
    near = D.distances(adjacent, sources, 4)
    paths = A.path_nodes(spark.createDataFrame([(1, "a", "u")], "qid long, source string, node string"), near, adjacent, 4)
    assert {r["node"] for r in paths.collect()} == {"a", "p", "q", "t", "u", "z", "r::1"}  # two ways over t, one over z
    degree = adjacent.groupBy("qid", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    proposed = spark.createDataFrame([(1, "a", "t", 0, 0.9), (1, "a", "u", 1, 0.5)], "qid long, source string, node string, rank long, score double")
    kept = A.reduced_nodes(adjacent, sources, proposed, near, degree, F.col("node").startswith("r::"), 4, reserve=2)
    assert {r["node"] for r in kept.collect()} == {"a", "p", "q", "t", "u", "r::1"}  # paths to the first proposal alone
    few = A.reduced_nodes(adjacent, sources, proposed, near, degree, F.col("node").startswith("r::"), 4, reserve=2, cap=2)
    assert {r["node"] for r in few.collect()} == {"a", "t"}
    assert {(r["src"], r["dst"]) for r in A.reduced_edges(adjacent, few).collect()} == set()


def test_bound_tables_follow_their_files(spark, tmp_path):
    table = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    table("benchmark", [(1, "Where is Lyon?")], "item_id long, text string")
    table("documents", [(1, TEXTS[0])], "doc_id long, text string")
    one = binding.Retrieval.of(spark, str(tmp_path))
    assert binding.Retrieval.of(spark, str(tmp_path)) is one
    table("documents", [(1, TEXTS[1]), (2, TEXTS[2])], "doc_id long, text string")
    assert binding.Retrieval.of(spark, str(tmp_path)) is not one
    binding.forget()
