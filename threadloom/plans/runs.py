"""Runs driven by settings: retrieval and answers for all questions, in one of the named methods."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config
from ..functions import text as T
from ..operators import generate
from ..operators import metrics as M
from ..operators import render as R
from ..sources.datasets import Registry
from .binding import Limits, Retrieval

METHODS = Registry("method")
RENDERS = Registry("render mode")
Built = Callable[[Retrieval, Mapping[str, Any]], DataFrame]


@METHODS.register("main", "corridor", "main_untrimmed", "naive")
def corridors(r: Retrieval, values: Mapping[str, Any]) -> DataFrame:
    """Units of the corridors, most relevant first: qid, pos, node, text, score."""
    return r.selected


@METHODS.register("flat", "dense")
def by_similarity(r: Retrieval, values: Mapping[str, Any]) -> DataFrame:
    """Units of the proposed documents by similarity alone."""
    return _placed(r.sentences.join(r.similarity, ["qid", "node"]).select("qid", "node", "text", T.settled(0.5 * (F.col("sim") + 1), 9).alias("score")))


@METHODS.register("ppr")
def by_mass(r: Retrieval, values: Mapping[str, Any]) -> DataFrame:
    """Units of the proposed documents by their mass over all runs."""
    best = r.mass.groupBy("qid", "node").agg(F.max("mass").alias("mass"))
    return _placed(r.sentences.join(best, ["qid", "node"]).select("qid", "node", "text", T.settled(F.col("mass"), 9).alias("score")))


#: Methods that go on with the best run alone, and those that trim what they have selected. ``naive`` does neither.
STABLE, TRIMMED = ("main", "corridor", "main_untrimmed"), ("main", "corridor")


def bound(questions: DataFrame, docs: DataFrame, values: Mapping[str, Any]) -> Retrieval:
    """The stages with the settings' numbers, for the settings' method."""
    method = str(values["method"])
    limits = Limits.of(values, stable=method in STABLE, trim=method in TRIMMED)
    return Retrieval(questions, docs, config.objective(str(values["retrieval_objective_mode"]))["shaping"], limits)


def variants(questions: DataFrame, docs: DataFrame, base: Retrieval, methods: Sequence[str] = ("main", "main_untrimmed", "naive")) -> dict[str, Retrieval]:
    """The same stages for several methods: those up to the runs' scores are made once, by ``base``, for all of them."""
    shared = ("tokens", "support", "anchors", "hits", "contexts", "edges", "adjacent", "degree", "sources", "distances", "run_edges", "mass", "sentences", "similarity", "unit_tokens", "anchor_similarity", "mentions", "grounding", "candidates", "components", "seed_scores", "seed_distances", "seeds", "runs")
    out = {}
    for m in methods:
        r = Retrieval(questions, docs, base.shaping, replace(base.limits, stable=m in STABLE, trim=m in TRIMMED))
        for stage in shared:
            vars(r)[stage] = getattr(base, stage)  # cached properties live in the instance
        out[m] = r
    return out


def _placed(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "node"))
    return rows.select("qid", (place - 1).cast("long").alias("pos"), "node", "text", "score")


@RENDERS.register("flat")
def flat(r: Retrieval, values: Mapping[str, Any], selected: DataFrame) -> DataFrame:
    return R.flat(selected.select("qid", "pos", "node", "text"), int(values["max_context_sentences"]))


@RENDERS.register("corridor")
def blocks(r: Retrieval, values: Mapping[str, Any], selected: DataFrame) -> DataFrame:
    budget = dict(corridors=int(values["max_corridors_in_context"]), main=int(values["max_main_sentences_per_corridor"]), support=int(values["max_support_per_corridor"]), budget=int(values["max_total_sentences"]))
    return R.corridor_context(r.units, r.ranked, r.selected.select("qid", "node", "text", F.col("score").alias("unit_score")), r.questions, **budget).select("qid", "context", "units", "truncated")


@RENDERS.register("corridor_aware_flat")
def diverse(r: Retrieval, values: Mapping[str, Any], selected: DataFrame) -> DataFrame:
    picked = R.mmr(r.features, int(values["max_context_sentences"]))
    lines = R.ordered(picked.select("qid", "node", "value"), r.features, str(values.get("order_strategy", "score"))).join(r.selected.select("qid", "node", "text"), ["qid", "node"])
    return R.flat(lines.select("qid", F.col("place").alias("pos"), "node", "text"), int(values["max_context_sentences"]))


@RENDERS.register("path_bundle")
def path_bundles(r: Retrieval, values: Mapping[str, Any], selected: DataFrame) -> DataFrame:
    found = R.bundles(r.units, r.ranked, r.features, str(values.get("order_strategy", "")), int(values["max_corridors_in_context"]), int(values["max_main_sentences_per_corridor"]), int(values["max_support_per_corridor"]))
    lines = found.join(r.selected.select("qid", "node", "text"), ["qid", "node"])
    place = F.row_number().over(Window.partitionBy("qid").orderBy("bundle", "place"))
    return R.flat(lines.select("qid", place.alias("pos"), "node", "text"), int(values["max_total_sentences"]))


def retrieve(questions: DataFrame, docs: DataFrame, values: Mapping[str, Any] | None = None) -> DataFrame:
    """Retrieved units of every question by the settings' method: qid, rank, unit_id, text, score."""
    values = values or config.settings()
    r = bound(questions, docs, values)
    found = METHODS[str(values["method"])](r, values)
    return _retrieved(found, values)


def _retrieved(found: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return found.filter(F.col("pos") < int(values["max_context_sentences"])).select("qid", (F.col("pos") + 1).alias("rank"), F.col("node").alias("unit_id"), "text", "score")


def render(r: Retrieval, values: Mapping[str, Any], selected: DataFrame) -> DataFrame:
    """Contexts in the settings' render mode: qid, context, units, truncated.

    Entity-chunk graphs are rendered flat whatever the mode. Where the delivery
    mode grounds contexts, excerpts around the corridors' units are added.
    """
    chunked = config.graph_mode(values["graph_mode"]) == "entity_chunk_graph"
    made = RENDERS["flat" if chunked else str(values.get("render_mode", "flat"))](r, values, selected)
    how = config.delivery(values)
    if not how["enabled"]:
        return made
    base = selected.filter(F.col("pos") < int(values["max_context_sentences"]))
    centers = R.backfill_centers(r.units, r.ranked, base.select("qid", "node", (F.col("pos") + 1).alias("place")))
    sents = r.sentences.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("unit_idx").cast("long").alias("unit_idx"), "node", "text").distinct()
    near = centers.withColumnRenamed("unit_idx", "center").join(sents, "doc_id").filter(F.abs(F.col("unit_idx") - F.col("center")) <= 1)
    taken = R.excerpt_units(near.select("qid", "rank", F.col("unit_idx").alias("pos"), "node", "text"), base, int(how["sentences"]))
    grounded = R.grounded_context(made.select("qid", "context", "units"), taken, int(values["max_total_sentences"]) + int(how["sentences"]), int(how["sentences"]))
    return grounded.join(made.select("qid", "truncated"), "qid").select("qid", "context", "units", "truncated")


def answer(questions: DataFrame, docs: DataFrame, golds: DataFrame | None = None, values: Mapping[str, Any] | None = None, provider: generate.Provider | None = None, stored: DataFrame | None = None, stages: Retrieval | None = None) -> dict[str, DataFrame]:
    """A whole run: ``retrieval``, ``contexts``, ``answers`` and, with golds (qid, golds), ``summary``.

    stored: retrieval results (qid, rank, unit_id, text, score) of a run before,
    which take the place of retrieval for their questions. stages: bound ones, with
    their own numbers, in place of new ones by the settings.
    """
    values = values or config.settings()
    r = stages or bound(questions, docs, values)
    selected = METHODS[str(values["method"])](r, values)
    if stored is not None:
        kept = stored.select("qid", (F.col("rank") - 1).cast("long").alias("pos"), F.col("unit_id").alias("node"), "text", "score")
        selected = kept.unionByName(selected.join(stored.select("qid").distinct(), "qid", "left_anti").select("qid", "pos", "node", "text", "score"))
    contexts = render(r, values, selected)
    lines = selected.select("qid", "text", (F.col("pos") + 1).alias("pos"))
    out = {"retrieval": _retrieved(selected, values), "contexts": contexts, "answers": generate.answers(contexts, questions, lines, provider)}
    if golds is not None:
        scored = M.score_answers(out["answers"].join(golds, "qid"), mode="parity" if values["evaluator_mode"] == "parity" else "legacy")
        sized = scored.join(contexts.select("qid", "units"), "qid", "left")
        out["summary"] = M.run_summary(sized, ["em", "f1", "units"], F.col("f1") > 0)
    return out

