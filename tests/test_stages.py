"""Operators behind the retrieval stages against values worked out by hand or by plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threadloom.functions import config, probe
from threadloom.operators import anchors, corridors, generate, metrics, render, reports, seeds, vectors
from threadloom.plans import runs
from threadloom.sources import index


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_error_buckets(spark):
    names = "qid long, run_bridge_coverage double, seed_bridge_recall double, rendered_recall double, seed_answer_recall double, answer_side_density double, precision double, rendered_precision double, bridge_noise_ratio double, redundancy_rate double, f1 double, qa_executed boolean"
    rows = [
        (1, 0.3, 0.34, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, True),
        (2, 0.35, 0.0, 0.2, 0.2, 0.24, 1.0, 1.0, 0.0, 0.0, 1.0, True),
        (3, 0.0, 0.5, 0.25, 0.0, 0.0, 1.0, 1.0, 0.9, 0.0, 0.01, True),
        (4, 0.5, 0.0, 0.0, 0.0, 0.3, 1.0, 1.0, 0.55, 0.0, 0.5, True),
        (5, 0.5, 0.0, 0.0, 0.0, 0.3, 0.2, 0.24, 0.0, 0.6, 0.5, True),
        (6, 0.5, 0.0, 0.0, 0.0, 0.3, 0.2, 0.24, 0.0, 0.0, 0.0, False),
        (7, 0.5, 0.0, 0.0, 0.0, 0.3, 0.3, 0.0, 0.5, 0.9, 0.1, True),
    ]
    got = metrics.evidence_flags(table(spark, rows, names)).select("qid", metrics.error_bucket(*map(F.col, ("bridge", "answer", "failed", "noisy"))).alias("b")).collect()
    want = {1: "bridge_missing", 2: "answer_side_missing", 3: "answer_present_generation_fail", 4: "bridge_present_noisy", 5: "bridge_present_noisy", 6: "bridge_present_noisy", 7: "none"}
    assert {r["qid"]: r["b"] for r in got} == want


def test_derived_figures(spark):
    rows = [(1, 0.8, 0.4, 0.2, 0.5, 50.0, 200.0, 0.6, 0.5, 0.9), (2, 0.0, 0.0, 0.2, 0.5, 0.0, 0.0, None, None, None)]
    df = table(spark, rows, "k int, recall double, rendered double, f1 double, recall_at_5 double, retrieval_ms double, total_ms double, ceiling double, reference_f1 double, reference_r5 double")
    a, b = metrics.derived(df).orderBy("k").collect()
    assert (a["retention"], a["conversion"], a["oracle_gap"], a["f1_per_100ms"], a["r5_per_100ms"], a["oracle_gap_per_ms"], a["gap_to_reference_f1"], a["gap_to_reference_r5"]) == (0.5, 0.5, 0.4, 0.1, 1.0, 0.002, 0.3, 0.4)
    assert {b[c] for c in ("retention", "conversion", "oracle_gap", "f1_per_100ms", "r5_per_100ms", "oracle_gap_per_ms", "gap_to_reference_f1", "gap_to_reference_r5")} == {0.0}


def test_recommendation(spark):
    stages = [s for group in reports.CASES.values() for s in group]
    base = dict.fromkeys(stages, 1.0) | {"retrieval_total_ms": 100.0, "proposal_subgraph_nodes": 10}
    cases = [
        ({"phase1_ppr_ms": 50.0}, "A", "phase1_ppr_ms"),
        ({"phase2_refine_ms": 50.0}, "B", "phase2_refine_ms"),
        ({"query_embed_ms": 9.0, "semantic_lookup_chunk_ms": 9.0, "phase1_ppr_ms": 10.0}, "C", "phase1_ppr_ms"),
        ({"proposal_union_ms": 50.0}, "D", "proposal_union_ms"),
        ({"render_ms": 50.0}, "E", "render_ms"),
        ({"render_ms": 50.0, "proposal_subgraph_build_ms": 15.0, "proposal_subgraph_nodes": 5000}, "D", "render_ms"),
        ({"phase1_ppr_ms": 2.0, "phase2_refine_ms": 2.0, "query_embed_ms": 1.0}, "A", "phase1_ppr_ms"),
    ]
    rows = [(i, *(float((base | change)[c]) for c in base)) for i, (change, _, _) in enumerate(cases)]
    got = reports.recommendation(table(spark, rows, "k int, " + ", ".join(f"{c} double" for c in base))).orderBy("k").collect()
    assert [(r["case"], r["primary_stage"]) for r in got] == [(c, s) for _, c, s in cases]


def test_support_match_reasons(spark):
    units = [(1, 1, "A::0", None), (1, 2, "A::5", None), (1, 3, "B::0", None), (1, 4, "chunk::A::0", "x  Alpha IS here y"), (1, 5, "chunk::A::1", "nothing"), (1, 6, "chunk::A::2", " "), (1, 7, "chunk::C::0", "Alpha is here"), (1, 8, "raw", None), (1, 9, "other", None)]
    gold = [(1, "A::0", "A", "alpha is here"), (1, "raw", "R", "z"), (1, "Z::1", "Z", "q")]
    u, g = table(spark, units, "qid int, rank int, unit_id string, text string"), table(spark, gold, "qid int, unit_id string, title string, text string")
    got = {r["unit_id"]: (r["matched"], r["reason"]) for r in metrics.support_matches(u, g).collect()}
    assert got["A::0"] == (["A::0"], "exact_sentence_id") and got["A::5"] == ([], "same_title_sentence_index_mismatch") and got["B::0"][1] == "sentence_title_not_in_gold"
    assert got["chunk::A::0"] == (["A::0"], "chunk_contains_gold_sentence") and got["chunk::A::1"][1] == "chunk_text_no_gold_sentence_match"
    assert got["chunk::A::2"] == ([], "chunk_text_missing") and got["chunk::C::0"][1] == "chunk_title_not_in_gold"
    assert got["raw"] == (["raw"], "exact_sentence_id_raw") and got["other"][1] == "unrecognized_unit_id_format"
    fallback = {r["unit_id"]: (r["matched"], r["reason"]) for r in metrics.support_matches(u, g, True).collect()}
    assert fallback["chunk::A::2"] == (["A::0"], "chunk_text_missing,chunk_title_fallback_no_text")
    debug = {r["unit_id"]: r["reason"] for r in metrics.support_debug(metrics.support_matches(u, g), g).collect()}
    assert debug == {"A::0": "matched", "raw": "matched", "Z::1": "no_predicted_unit_with_same_title"}


def test_shared_tokens_is_a_multiset(spark):
    df = table(spark, [(["a", "b", "a", "c"], ["a", "a", "a", "d", "c"]), ([], ["a"]), (["x"], [])], "l array<string>, r array<string>")
    assert [r["n"] for r in df.select(metrics.shared_tokens(F.col("l"), F.col("r")).alias("n")).collect()] == [3, 0, 0]


def test_flat_order_penalties(spark):
    """Worked out by hand: base, connector terms, repeats of a document, and the balance of roles."""
    fields = "qid int, pos int, node string, text string, best_rank int, best_score double, is_main boolean, is_support boolean, is_connector boolean, overlap int, locality double, base double"
    rows = [
        (1, 0, "s::1:0", "aa", 1, 0.0, False, True, True, 0, 0.0, 0.50),
        (1, 1, "s::1:1", "bb", 1, 0.0, False, True, True, 0, 0.0, 0.49),
        (1, 2, "s::2:0", "cc", 9, 0.0, False, False, False, 0, 0.0, 0.90),
    ]
    got = [(r["node"], r["value"]) for r in render.mmr(table(spark, rows, fields)).orderBy("place").collect()]
    # first: .5 + .2 + .2 + .05; then the plain one; the second bridge repeats a document and its role
    assert got[0] == ("s::1:0", 0.95) and got[1] == ("s::2:0", 0.9) and got[2] == ("s::1:1", 0.89)
    near = [r["node"] for r in render.mmr(table(spark, rows, fields), corridors=3).orderBy("place").collect()]
    assert near == ["s::1:0", "s::1:1"]


def test_excerpts_fill_what_the_budget_leaves(spark):
    packages = table(spark, [(1, 1, 0, "a", "A"), (1, 1, 1, "b", "B"), (1, 2, 0, "b", "B"), (1, 2, 1, "c", " "), (1, 2, 2, "d", "D")], "qid int, rank int, pos int, node string, text string")
    base = table(spark, [(1, "a")], "qid int, node string")
    got = [(r["place"], r["node"], r["candidates"]) for r in render.excerpt_units(packages, base).orderBy("place").collect()]
    assert got == [(1, "b", 2), (2, "d", 2)]
    assert [r["node"] for r in render.excerpt_units(packages, base, dedup=False, most=3).orderBy("place").collect()] == ["a", "b", "b"]
    whole = table(spark, [(1, "ctx", 7)], "qid int, context string, units int")
    out = render.grounded_context(whole, render.excerpt_units(packages, base), 8).first()
    assert (out["context"], out["units"], out["excerpts"]) == ("ctx\n\n[Grounded Chunk Excerpts]\n- B", 8, 1)


def test_proposal_levels():
    assert anchors.proposal_level("nonsense")["local"] == 40 and anchors.proposal_level("off")["entity"] == 16
    mild, hard = anchors.proposal_level("mild"), anchors.proposal_level("aggressive")
    assert (mild["entity"], mild["hops"], mild["local"]) == (15, 3, 36) and (hard["entity"], hard["chunk"], hard["support"], hard["hops"], hard["local"]) == (11, 10, 2, 2, 24)


def test_local_refinement(spark):
    """A line of six nodes: the walk from one end and nearness to the other, in plain Python."""
    nodes = [f"s::1:{i}" for i in range(6)]
    edges = [{"src": a, "dst": b} for i in range(5) for a, b in ((nodes[i], nodes[i + 1]), (nodes[i + 1], nodes[i]))]
    walk, dist = corridors.local_walk(nodes, edges, nodes[0], nodes[5], 5)
    assert abs(sum(walk.values()) - 1) < 1e-9 and dist == {n: 5 - i for i, n in enumerate(nodes)}
    mass = [1.0, 0, 0, 0, 0, 0]
    for _ in range(80):
        new = [0.15 if i == 0 else 0.0 for i in range(6)]
        for i in range(6):
            ends = [j for j in (i - 1, i + 1) if 0 <= j < 6]
            for j in ends:
                new[j] += 0.85 * mass[i] / len(ends)
        done = sum(abs(a - b) for a, b in zip(new, mass, strict=True)) < 6e-6
        mass = new
        if done:
            break
    assert all(abs(walk[n] - m) < 1e-9 for n, m in zip(nodes, mass, strict=True))
    pairs = table(spark, [(1, 1, nodes[0], nodes[5], 0, 5, 0.5)], "qid long, rank long, source string, seed string, run int, dist int, pair_score double")
    near = table(spark, [(1, nodes[0], n, i) for i, n in enumerate(nodes)], "qid long, source string, node string, dist int")
    far = table(spark, [(1, nodes[5], n, 5 - i) for i, n in enumerate(nodes)], "qid long, source string, node string, dist int")
    paths = table(spark, [(1, 1, nodes)], "qid long, rank long, path array<string>")
    sim = table(spark, [(1, n, 0.0) for n in nodes], "qid long, node string, sim double")
    adjacent = table(spark, [(1, e["src"], e["dst"]) for e in edges], "qid long, src string, dst string")
    local = corridors.local_nodes(pairs, near, far, paths, sim, 4)
    assert {r["node"] for r in local.collect()} == {nodes[0], nodes[1], nodes[4], nodes[5]}
    every = corridors.local_nodes(pairs, near, far, paths, sim)
    refined = corridors.refine(every, adjacent, pairs, table(spark, [(1, 0, nodes[0], 1.0)], "qid long, run int, node string, mass double"))
    low, high = min(mass), max(mass)
    want = {n: 0.40 * (m - low) / (high - low) + 0.25 * i / 5 + 0.20 * (i == 0) + 0.15 for i, (n, m) in enumerate(zip(nodes, mass, strict=True))}
    got = {r["node"]: r["score"] for r in refined.collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 2e-6 for n in nodes)
    units, induced = corridors.merge_refined(refined, adjacent)
    assert units.count() == 6 and induced.count() == 10


def test_shaping_terms(spark):
    names = ["support_set_compactness", "path_complete_score", "bridge_answer_pair_retention", "answer_side_density", "path_complete", "incomplete_path_rate", "answer_chain", "chain_compactness", "span", "bridge_purity", "bridge_noise_ratio", "anchor", "bridge", "support_density"]
    row = (0.5, 0.8, 1.0, 0.65, True, 0.0, 0.9, 0.7, 5, 0.6, 0.4, 0.9, 0.7, 0.5)
    df = spark.createDataFrame([row], names)
    value = lambda **s: corridors.shaped(df, s).first()["shaping"]
    assert value() == 0.0 and value(compact=0.2) == 0.1 and value(bridge_purity=0.5) == 0.2
    assert value(path_preserve=0.1) == 0.08 and value(path_preserve=0.1, path_guarded=True) == 0.056
    assert value(path_preserve=0.1, path_compact=0.1) == pytest.approx(0.08 + 0.02 - 0.06)
    assert value(answer_preserve=0.1) == pytest.approx(0.065)
    assert value(answer_preserve=0.1, confidence_gated=True) == pytest.approx(0.1 * 0.65 * 0.65)
    assert value(answer_preserve=0.1, guarded_dataset=True) == pytest.approx(0.1 * 0.35 * 0.35 * 0.65)


def test_redundancy_and_grounding(spark):
    chosen = table(spark, [(1, 0, "a"), (1, 0, "b"), (1, 0, "c"), (2, 0, "d")], "qid int, run int, node string")
    tokens = table(spark, [(1, "a", ["x", "y"]), (1, "b", ["x", "z"]), (2, "d", ["q"])], "qid int, node string, tokens array<string>")
    assert {r["qid"]: r["redundancy"] for r in seeds.semantic_redundancy(chosen, tokens).collect()} == {1: 0.333333, 2: 0.0}
    links = table(spark, [(1, "a", "u"), (1, "a", "v"), (1, "b", "w")], "qid int, node string, linked string")
    nodes = table(spark, [(1, 0, "v")], "qid int, run int, node string")
    assert {r["qid"]: r["grounding"] for r in seeds.chunk_grounding(chosen, nodes, links).collect()} == {1: 0.5, 2: 0.0}


def test_index_is_loaded_or_built(spark, tmp_path):
    docs = table(spark, [(1, "Lyon lies on the Rhone. The Rhone ends at sea."), (2, "Marie Curie was a physicist.")], "doc_id long, text string")
    root, values = str(tmp_path / "index"), config.settings()
    first, meta = index.load_index(spark, root, docs, values, index.hashed_encoder())
    assert not meta["graph"]["loaded"] and not meta["vectors"]["loaded"] and first["vectors"].count() == first["nodes"].count() > 0
    again, meta = index.load_index(spark, root, docs.orderBy(F.desc("doc_id")), values, index.hashed_encoder())
    assert meta["graph"]["loaded"] and meta["vectors"]["loaded"] and sorted(map(str, again["edges"].collect())) == sorted(map(str, first["edges"].collect()))
    # another graph setting, the same nodes and encoder: vectors come from the index there is
    _, meta = index.load_index(spark, root, docs, values | {"support_topk_chunks": 2}, index.hashed_encoder())
    assert not meta["graph"]["loaded"] and meta["vectors"]["reused"]
    asked = table(spark, [(1, "Where does the Rhone end?"), (2, "who?")], "qid long, text string")
    one = index.question_vectors(spark, root, asked, index.hashed_encoder()).orderBy("qid").collect()
    assert index.question_vectors(spark, root, asked, index.hashed_encoder()).orderBy("qid").collect() == one
    assert spark.read.parquet(f"{root}/questions-hashed-64").count() == 2
    with pytest.raises(ValueError):
        index.corpus_graph(docs, {"index_layers": ("nonsense",)})


def test_extraction_with_failures(spark):
    def provider(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("no answer")
        return ['[["Lyon", "lies on", "Rhone"]]' if "Lyon" in p else "nothing to say" for p in prompts]

    units = table(spark, [("k1", "Lyon lies on the Rhone"), ("k2", "plain"), ("k3", "boom")], "cache_key string, text string").coalesce(1)
    triples, counts = index.extract(units, provider, batch=1)
    assert [(r["cache_key"], r["subject"], r["object"]) for r in triples.collect()] == [("k1", "Lyon", "Rhone")]
    assert {r["what"]: r["n"] for r in counts.collect()} == {"units": 3, "triples": 1, "errors": 1, "empty": 1, "unreadable": 1}
    made = generate.generate(units.select(F.col("cache_key").alias("qid"), F.col("text").alias("prompt")), provider, 1, "string")
    assert [r["n"] for r in index.top_errors(made).collect()] == [1]


def test_http_provider():
    import json
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            good = "max_completion_tokens" in body
            answer = {"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}]} if good else {"error": "max_tokens is not known"}
            self.send_response(200 if good else 400)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert generate.http_provider(f"http://127.0.0.1:{server.server_port}", "m")(["a", "b"]) == ["A", "B"]
    finally:
        server.shutdown()


def test_lookup_strategies(spark):
    cached = table(spark, [(1, "a", 0.9), (1, "b", 0.8), (2, "a", 0.5)], "qid int, node string, score double")
    scanned = table(spark, [(1, "c", 1.0), (2, "d", 0.7), (2, "e", 0.6)], "qid int, node string, score double")
    names = lambda s: sorted((r["qid"], r["rank"], r["node"]) for r in vectors.lookup(s, cached, scanned, 2).collect())
    assert names("full") == [(1, 1, "c"), (2, 1, "d"), (2, 2, "e")] and names("cache_only") == [(1, 1, "a"), (1, 2, "b"), (2, 1, "a")]
    assert names("two_tier") == names("adaptive") == [(1, 1, "a"), (1, 2, "b"), (2, 1, "d"), (2, 2, "e")]


def test_runs_by_settings(spark):
    docs = table(spark, [(1, "Lyon lies on the Rhone. The Rhone ends at the Mediterranean. Boats go there."), (2, "Marie Curie was a physicist. She lived in Paris."), (3, "The Rhone rises in a glacier. Glaciers melt.")], "doc_id long, text string")
    asked = table(spark, [(1, "Where does the Rhone of Lyon end, the Mediterranean?"), (2, "Was Curie a physicist in Paris?")], "qid long, text string")
    golds = table(spark, [(1, ["The Rhone ends at the Mediterranean."]), (2, ["yes"])], "qid long, golds array<string>")
    values = config.settings(overrides={"delivery_mode": "chunk_package_basic"})
    r = runs.bound(asked, docs, values)
    for method in ("main", "flat", "ppr"):
        assert {x["qid"] for x in runs.METHODS[method](r, values).collect()} == {1, 2}
    selected = runs.METHODS["main"](r, values)
    for mode in ("flat", "corridor", "corridor_aware_flat", "path_bundle"):
        assert runs.render(r, values | {"render_mode": mode}, selected).filter("units > 0").count() == 2
    out = runs.answer(asked, docs, golds, values | {"method": "flat"}, provider=lambda prompts: ["Answer: yes"] * len(prompts))
    assert {x["prediction"] for x in out["answers"].collect()} == {"yes"} and out["summary"].first()["em"] == 0.5
    assert min(x["rank"] for x in out["retrieval"].collect()) == 1
    stored = table(spark, [(1, 1, "s::9:9", "A stored sentence on the Rhone.", 1.0)], "qid long, rank long, unit_id string, text string, score double")
    again = runs.answer(asked, docs, values=config.settings(overrides={"method": "flat"}), stored=stored)
    assert {r["qid"]: r["prediction"] for r in again["answers"].collect()}[1] == "A stored sentence on the Rhone."
    with pytest.raises(KeyError):
        runs.retrieve(asked, docs, config.settings(overrides={"method": "nonsense"}))


def test_probe():
    timer = probe.Timer()
    assert probe.rss_mb() > 1 and timer.ms() >= 0 and index.timestamp().endswith("Z")
