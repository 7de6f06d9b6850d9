"""Settings: files, overrides, audit, and the named modes that stand for groups of values."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

GRAPH_MODES = ("current_entity_graph", "entity_chunk_graph")

#: Defaults of the settings that the stages read.
DEFAULTS: dict[str, Any] = {
    "dataset": "hotpotqa", "split": "validation", "method": "main", "limit": None, "graph_mode": "current_entity_graph", "index_chunk_unit": "auto",
    "passage_chunk_size_sentences": 3, "passage_chunk_stride_sentences": 2, "passage_chunk_min_sentences": 2, "passage_chunk_max_chars": 900,
    "max_anchors": 5, "samples_per_anchor": 3, "candidate_top_t": 20, "seed_k": 4, "tau": 4, "pair_shortlist_topb": 6,
    "semantic_topn_entity": 30, "semantic_topn_chunk": 15, "graph_reserve_topn": 15, "embedding_weight": 0.35, "embedding_rerank_topn": 80,
    "phase1_run_preshortlist_topm": 3, "phase1_full_run_score_topk": 2, "max_context_sentences": 14, "max_corridors_in_context": 3,
    "max_main_sentences_per_corridor": 3, "max_support_per_corridor": 2, "max_total_sentences": 14, "delivery_mode": "sentence_compressed",
    "chunk_grounding_enabled": False, "chunk_grounding_mode": "sentence_backfill", "chunk_grounding_top_k_packages": 4, "chunk_excerpt_max_total_sentences": 4,
    "max_chunk_packages": 4, "max_excerpt_sentences_per_package": 3, "package_score_support_weight": 0.15, "package_score_chunk_grounding_weight": 0.15,
    "evaluator_mode": "legacy", "generator": "heuristic", "retrieval_objective_mode": "baseline", "render_mode": "flat", "order_strategy": "score",
}

RUN_WEIGHTS = ("semantic", "anchor", "structure", "bridge", "redundancy", "pair_coverage", "completeness", "grounding", "dispersion", "seed_bridge", "seed_coverage")
#: Weight profiles of run and seed scores, in the order of RUN_WEIGHTS.
PROFILES = {
    "cfg": (0.30, 0.20, 0.25, 0.15, 0.10, 0, 0, 0, 0, 0.20, 0.10),
    "BA": (0.22, 0.18, 0.22, 0.22, 0.08, 0.04, 0.04, 0, 0, 0.28, 0.12),
    "RB": (0.20, 0.20, 0.20, 0.16, 0.08, 0.08, 0.05, 0.03, 0.08, 0.24, 0.20),
    "BL": (0.24, 0.20, 0.24, 0.18, 0.10, 0.02, 0.02, 0, 0, 0.24, 0.14),
    "CC": (0.22, 0.18, 0.22, 0.24, 0.08, 0.03, 0.03, 0, 0, 0.28, 0.16),
}
#: Objective modes as (anchor recall, bridge induction, coverage selection, profile); None leaves the setting.
OBJECTIVES: dict[str, tuple[bool | None, bool | None, bool | None, str]] = {
    "baseline": (None, None, None, "cfg"),
    "hybrid_anchor_recall": (True, None, None, "cfg"),
    "bridge_candidate_induction": (None, True, None, "cfg"),
    "role_aware_chunk_scoring": (None, None, None, "cfg"),
    "coverage_selection": (None, None, True, "cfg"),
    "bridge_coverage_full": (True, True, True, "cfg"),
    "run_objective_bridge_aware": (None, False, False, "BA"),
    "run_objective_role_balanced": (None, False, False, "RB"),
    "corridor_role_constrained": (None, False, True, "cfg"),
    "bridge_aware_run_plus_role_constrained_corridor": (None, False, True, "BA"),
    "seed_quality_analysis": (None, False, False, "cfg"),
    "r2_bridge_only": (None, True, False, "BL"),
    "r2_connector_core": (None, True, False, "BL"),
    "r2_plus_r3_anchor_light": (None, True, False, "BL"),
    "r2_plus_r3_answer_light": (None, True, False, "BL"),
    "r2_plus_path_preserve": (None, True, False, "BL"),
    "r2_plus_path_preserve_compact": (None, True, False, "BL"),
    "r2_plus_path_preserve_guarded": (None, True, False, "BL"),
    "r2_plus_path_preserve_compact_lite": (None, True, False, "BL"),
    "seed_run_connector_core": (None, True, False, "CC"),
    "seed_run_connector_core_corridor_compact": (None, True, False, "CC"),
    "seed_run_connector_core_corridor_answer_preserve": (None, True, False, "CC"),
    "seed_run_connector_core_corridor_bridge_purity": (None, True, False, "CC"),
    "seed_run_connector_core_corridor_compact_answer_preserve": (None, True, False, "CC"),
    "p3_answer_preserve_base": (None, True, False, "CC"),
    "p3_answer_preserve_guarded_hotpot": (None, True, False, "CC"),
    "p3_answer_preserve_confidence_gated": (None, True, False, "CC"),
}
#: Modes that score chunks by their role.
ROLE_CHUNKS = ("role_aware_chunk_scoring", "bridge_coverage_full", "r2_plus_r3_anchor_light", "r2_plus_r3_answer_light")
_COMPACT, _ANSWER, _PURITY = {"compact": 0.18}, {"answer_preserve": 0.22}, {"bridge_purity": 0.22}
_PATH = {"path_preserve": 0.26, "path_incomplete": 0.14}
#: Corridor shaping of the modes that have any.
SHAPES: dict[str, dict[str, Any]] = {
    "r2_plus_path_preserve": _PATH,
    "r2_plus_path_preserve_compact": _COMPACT | _PATH | {"path_compact": 0.14},
    "r2_plus_path_preserve_guarded": {"path_preserve": 0.20, "path_incomplete": 0.10, "path_guarded": True, "guard_scale": 0.60, "guard_complete": 0.74, "guard_pair": 0.60, "guard_density": 0.66},
    "r2_plus_path_preserve_compact_lite": _COMPACT | {"path_preserve": 0.23, "path_incomplete": 0.14, "path_compact": 0.08, "path_compact_lite": True, "lite_scale": 0.55, "lite_overflow": 0.012, "lite_cap": 0.06},
    "seed_run_connector_core_corridor_compact": _COMPACT,
    "seed_run_connector_core_corridor_answer_preserve": _ANSWER,
    "seed_run_connector_core_corridor_bridge_purity": _PURITY,
    "seed_run_connector_core_corridor_compact_answer_preserve": _COMPACT | _ANSWER,
    "p3_answer_preserve_base": _ANSWER,
    "p3_answer_preserve_guarded_hotpot": _ANSWER | {"guarded_dataset": True},
    "p3_answer_preserve_confidence_gated": {"answer_preserve": 0.18, "confidence_gated": True, "light_boost": 0.55},
}
#: Budget profiles as (proposal steps, exploration steps).
BUDGETS = {"off": (0, 0), "g1_proposal": (1, 0), "g2_exploration": (0, 1), "g_shared": (1, 1), "t_hotpot": (0, 2), "t_2wiki": (2, 0)}


def parse_bool(value: Any) -> bool:
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    if word in ("1", "true", "t", "yes", "y", "on"):
        return True
    if word in ("0", "false", "f", "no", "n", "off"):
        return False
    raise ValueError(f"not a boolean: {value!r}")


def _scalar(word: str) -> Any:
    word = word.strip()
    if word.lower() in ("", "null", "none", "~"):
        return None
    if word.lower() in ("true", "false"):
        return word.lower() == "true"
    try:
        return json.loads(word)
    except ValueError:
        return word.strip("'\"")


def load_file(path: str) -> dict[str, Any]:
    """Flat ``key: value`` lines with comments; what the settings files consist of."""
    out: dict[str, Any] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            body = line.split(" #")[0].rstrip()
            if body and not body.lstrip().startswith("#"):
                key, colon, value = body.partition(":")
                if not colon or key != key.strip():
                    raise ValueError(f"{path}: not a flat mapping: {line!r}")
                out[key] = _scalar(value)
    return out


def settings(file: str | None = None, overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults, then the file, then overrides; those that are None are ignored, and booleans may come as words."""
    out = DEFAULTS | (load_file(file) if file else {})
    for key, value in (overrides or {}).items():
        if value is not None:
            out[key] = parse_bool(value) if isinstance(out.get(key), bool) else value
    out["graph_mode"] = graph_mode(out["graph_mode"])
    out["index_chunk_unit"] = chunk_unit(out["index_chunk_unit"], out["graph_mode"])
    return out


def graph_mode(value: Any) -> str:
    mode = str(value or "").strip().lower()
    return mode if mode in GRAPH_MODES else GRAPH_MODES[0]


def chunk_unit(value: Any, mode: str) -> str:
    unit = str(value or "").strip().lower()
    if unit in ("", "auto"):
        return "passage" if graph_mode(mode) == "entity_chunk_graph" else "sentence"
    return "passage" if unit in ("passage", "chunk", "document", "doc") else "sentence"


def audit(path: str, values: Mapping[str, Any]) -> list[tuple[str, Any, Any]]:
    """(field, expected, found) wherever a file's name or its strategy contradicts its values."""
    name, hints = os.path.basename(path).lower(), {}
    if "entity_chunk_graph" in name:
        hints["graph_mode"] = "entity_chunk_graph"
    elif any(w in name for w in ("fusion", "semantic_bridge", "baseline_aggressive", "top1corr")):
        hints["graph_mode"] = "current_entity_graph"
    if "mixed_diffusion" in name or "entity_seed_chunk_lift" in name:
        hints["chunk_node_enabled_in_diffusion"] = "mixed_diffusion" in name
    found = [(k, v, values[k]) for k, v in hints.items() if k in values and values[k] != v]
    if graph_mode(values.get("graph_mode")) == "entity_chunk_graph":
        for key in ("samples_per_anchor", "phase1_run_preshortlist_topm", "phase1_full_run_score_topk"):
            if int(values.get(key, 1) or 1) <= 1:
                found.append((key, ">=2 for stable run selection", values.get(key, 1)))
    return found


def delivery(values: Mapping[str, Any]) -> dict[str, Any]:
    """Chunk grounding that a delivery mode stands for: how excerpts are chosen, how many, and least weights."""
    mode, chunked = str(values["delivery_mode"]).lower(), graph_mode(values["graph_mode"]) == "entity_chunk_graph"
    out = {"enabled": bool(values["chunk_grounding_enabled"]), "mode": values["chunk_grounding_mode"]}
    if chunked:
        out["enabled"] = False
    elif mode != "sentence_compressed":
        out["enabled"] = True
        out["mode"] = {"chunk_package_basic": "package_score", "chunk_grounded_bridge": "corridor_lift", "chunk_package_grounded_support": "package_score"}.get(mode, out["mode"])
    out["packages"] = int(values["max_chunk_packages"]) or int(values["chunk_grounding_top_k_packages"])
    out["sentences"] = max(int(values["chunk_excerpt_max_total_sentences"]), int(values["max_excerpt_sentences_per_package"]) * out["packages"])
    floor = (0.22, 0.20) if mode == "chunk_package_grounded_support" else (0.0, 0.0)
    out["support_weight"] = max(float(values["package_score_support_weight"]), floor[0])
    out["grounding_weight"] = max(float(values["package_score_chunk_grounding_weight"]), floor[1])
    return out


def objective(mode: str) -> dict[str, Any]:
    """Flags, weights and corridor shaping of an objective mode."""
    recall, bridge, coverage, profile = OBJECTIVES[mode]
    return {"role_chunks": mode in ROLE_CHUNKS, "shaping": SHAPES.get(mode, {}), "anchor_recall": recall, "bridge_induction": bridge, "coverage_selection": coverage, "weights": dict(zip(RUN_WEIGHTS, PROFILES[profile], strict=True))}


def budgeted(values: Mapping[str, Any], profile: str) -> dict[str, Any]:
    """Settings with a budget profile's steps added; the given ones stay as they are."""
    proposal, exploration = BUDGETS[profile]
    step = {"semantic_topn_entity": 2 * proposal, "semantic_topn_chunk": proposal, "graph_reserve_topn": proposal} | dict.fromkeys(("max_anchors", "samples_per_anchor", "phase1_run_preshortlist_topm", "phase1_full_run_score_topk"), exploration)
    return {k: v + step[k] if k in step else v for k, v in values.items()}
