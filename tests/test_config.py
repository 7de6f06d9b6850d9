"""Settings and generation providers."""

from __future__ import annotations

import pytest

from threadloom.functions import config
from threadloom.operators import generate


def test_file_and_overrides(tmp_path):
    path = tmp_path / "retrieval_fusion.yaml"
    path.write_text("# a comment\nseed_k: 6\ntrim: true\ngraph_mode: entity_chunk_graph\nname: 'x'\nlimit: null\n")
    s = config.settings(str(path), {"seed_k": None, "max_anchors": 9, "chunk_grounding_enabled": "yes"})
    assert (s["seed_k"], s["max_anchors"], s["chunk_grounding_enabled"], s["index_chunk_unit"], s["name"], s["limit"]) == (6, 9, True, "passage", "x", None)
    found = {f for f, _, _ in config.audit(str(path), s | {"samples_per_anchor": 1})}
    assert found == {"graph_mode", "samples_per_anchor"}
    with pytest.raises(ValueError):
        config.parse_bool("maybe")


def test_modes():
    assert config.graph_mode("nonsense") == "current_entity_graph"
    assert config.objective("seed_run_connector_core")["weights"]["bridge"] == 0.24
    assert config.budgeted(config.DEFAULTS, "g_shared")["max_anchors"] == 6 and config.DEFAULTS["max_anchors"] == 5
    d = config.delivery(config.DEFAULTS | {"delivery_mode": "chunk_package_grounded_support"})
    assert d["enabled"] and d["mode"] == "package_score" and d["support_weight"] == 0.22 and d["sentences"] == 12
    assert not config.delivery(config.DEFAULTS | {"delivery_mode": "chunk_grounded_bridge", "graph_mode": "entity_chunk_graph"})["enabled"]


def test_providers(spark):
    questions = spark.createDataFrame([(1, "Were they the same?"), (2, "Which town?")], "qid long, text string")
    contexts = spark.createDataFrame([(1, "c"), (2, "d")], "qid long, context string")
    units = spark.createDataFrame([(1, 0, "No idea."), (2, 0, "Nothing here."), (2, 1, "The town is Lyon.")], "qid long, pos int, text string")
    plain = {r["qid"]: r["prediction"] for r in generate.answers(contexts, questions, units).collect()}
    assert plain == {1: "No idea.", 2: "The town is Lyon."}
    said = lambda prompts: ["<think>x</think>\nNo, they were not." for _ in prompts]
    assert {r["prediction"] for r in generate.answers(contexts, questions, units, said).filter("qid = 1").collect()} == {"no"}

    def broken(prompts):
        raise RuntimeError("out of service")

    rows = generate.answers(contexts, questions, units, broken).collect()
    assert {r["qid"]: r["prediction"] for r in rows} == plain and all("out of service" in r["raw"] for r in rows)


def test_limit_names_and_retries():
    def call(prompts, **limits):
        if "max_tokens" in limits:
            raise ValueError("unknown parameter max_tokens")
        return [str(limits)] * len(prompts)

    assert generate.with_token_limit(call, 5)(["a"]) == ["{'max_completion_tokens': 5}"]
    tries = []

    def flaky(prompts):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError
        return prompts

    assert generate.with_retries(flaky, 3, 0)(["a"]) == ["a"] and len(tries) == 3
