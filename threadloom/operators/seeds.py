"""Seed components, greedy seed sets, and scores of retrieval runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SEED_WEIGHTS = {"graph": 0.45, "semantic": 0.35, "anchor": 0.20, "bridge": 0.0, "ground": 0.0}
RUN_WEIGHTS = {"semantic": 0.30, "anchor": 0.20, "structure": 0.25, "bridge": 0.15, "redundancy": 0.10}


def bridge_bonus(distances: DataFrame, tau: int = 4) -> DataFrame:
    """Share of a question's anchors within tau of a node, and .2 more for two or more (at most 1)."""
    anchors = distances.groupBy("qid").agg(F.count_distinct("source").alias("n"))
    near = distances.filter(F.col("dist") <= tau).groupBy("qid", "node").agg(F.count_distinct("source").alias("k"))
    return near.join(anchors, "qid").select("qid", "node", F.least(F.lit(1.0), F.col("k") / F.col("n") + F.when(F.col("k") >= 2, 0.2).otherwise(0.0)).alias("bridge"))


def grounding_bonus(links: DataFrame, similarity: DataFrame, most: int = 12, best: int = 3) -> DataFrame:
    """Mean of the three largest (sim + 1)/2 over a node's first twelve linked units."""
    w = Window.partitionBy("qid", "node")
    cut = links.withColumn("r", F.row_number().over(w.orderBy("rank", "unit"))).filter(F.col("r") <= most)
    scored = cut.join(similarity.select("qid", F.col("node").alias("unit"), "sim"), ["qid", "unit"]).withColumn("g", 0.5 * (F.col("sim") + 1))
    return scored.withColumn("t", F.row_number().over(w.orderBy(F.desc("g"), "unit"))).filter(F.col("t") <= best).groupBy("qid", "node").agg(F.avg("g").alias("ground"))


def seed_scores(parts: DataFrame, weights: dict[str, float] | None = None, keys: tuple[str, ...] = ("qid", "run")) -> DataFrame:
    """Weighted sum of components, each to 0..1 over its run: graph, semantic and anchor (similarities), bridge, ground."""
    w = weights or SEED_WEIGHTS
    total = sum(max(0.0, x) for x in w.values())
    share = {k: max(0.0, x) / total for k, x in w.items()} if total else {"graph": 1.0}
    of = {"graph": F.col("graph"), "semantic": 0.5 * (F.col("semantic") + 1), "anchor": 0.5 * (F.col("anchor") + 1), "bridge": F.col("bridge"), "ground": F.col("ground")}
    terms = [share[k] * T.min_max_map(of[k], *keys) for k in share if share[k] > 0]
    return parts.withColumn("seed_score", T.rounded(sum(terms, F.lit(0.0)), 9))


def objective_weights(scored: DataFrame, bridge: float = 0.20, coverage: float = 0.10) -> DataFrame:
    """What the seed set is chosen by: score + .20 bridge + .15 grounding + .10 anchor coverage."""
    return scored.withColumn("weight", T.rounded(F.col("seed_score") + bridge * F.col("bridge") + 0.15 * F.col("ground") + coverage * F.col("coverage"), 9))


def choose_seeds(weight: np.ndarray, dist: np.ndarray, k: int, tau: int) -> list[int]:
    """Greedy weighted k-median: each round takes the first candidate that lowers the sum of weighted distances most.

    Weights count to nine digits, distances in whole steps; the sums are exact and rounded half up to seven digits, so that
    ties are ties in any order of the sum.
    """
    units = np.rint(np.asarray(weight, float) * 1e9).astype(np.int64)
    best = np.full(len(units), tau, np.int64)
    chosen: list[int] = []
    cost = np.minimum(dist, tau).astype(np.int64)
    for _ in range(min(k, len(units))):
        value = (np.minimum(best[:, None], cost).T @ units + 50) // 100
        value[chosen] = np.iinfo(np.int64).max
        j = int(np.argmin(value))
        chosen.append(j)
        best = np.minimum(best, cost[:, j])
    return chosen


def greedy_seeds(candidates: DataFrame, pairs: DataFrame, k: int = 4, tau: int = 4) -> DataFrame:
    """Seed set of each (qid, run) among its candidates (at most a few dozen): a sequential choice, so one small group at a time.

    candidates: qid, run, rank, node, weight; pairs: qid, run, node, other, dist.
    """
    nodes = candidates.groupBy("qid", "run").agg(F.array_sort(F.collect_list(F.struct("rank", "node", "weight"))).alias("c"))
    near = pairs.groupBy("qid", "run").agg(F.collect_list(F.struct("node", "other", "dist")).alias("d"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for qid, r, c, d in b[["qid", "run", "c", "d"]].itertuples(index=False):
                at = {x["node"]: i for i, x in enumerate(c)}
                m = np.full((len(c), len(c)), float(tau))
                np.fill_diagonal(m, 0.0)
                for x in [] if d is None else d:
                    if x["node"] in at and x["other"] in at:
                        m[at[x["node"]], at[x["other"]]] = min(tau, x["dist"])
                picked = choose_seeds(np.asarray([x["weight"] for x in c]), m, k, tau)
                out += [(qid, r, n + 1, c[i]["node"]) for n, i in enumerate(picked)]
            yield pd.DataFrame(out, columns=["qid", "run", "pick", "node"])

    return nodes.join(near, ["qid", "run"], "left").mapInPandas(run, "qid long, run int, pick int, node string")


def precheck(candidates: DataFrame, seeds: DataFrame, distances: DataFrame, tau: int = 4) -> DataFrame:
    """Cheap score of a run: .40 seed mass + .25 anchor coverage + .20 best similarity + .15 bridge proxy."""
    total = candidates.groupBy("qid", "run").agg(F.sum("score").alias("total"))
    chosen = seeds.select("qid", "run", "node").join(candidates, ["qid", "run", "node"])
    mass = chosen.groupBy("qid", "run").agg(F.sum("score").alias("mass"), F.max(0.5 * (F.col("sim") + 1)).alias("semantic"))
    near = seeds.select("qid", "run", "node").join(distances.filter(F.col("dist") <= tau), ["qid", "node"])
    anchors = distances.groupBy("qid").agg(F.count_distinct("source").alias("anchors"))
    covered = near.groupBy("qid", "run").agg(F.count_distinct("source").alias("covered"))
    bridging = near.groupBy("qid", "run", "node").agg(F.count_distinct("source").alias("k")).groupBy("qid", "run").agg(F.sum(F.when(F.col("k") >= 2, 1).otherwise(0)).alias("bridges"))
    picked = seeds.groupBy("qid", "run").agg(F.count(F.lit(1)).alias("picked"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = total.join(mass, ["qid", "run"], "left").join(covered, ["qid", "run"], "left").join(bridging, ["qid", "run"], "left").join(picked, ["qid", "run"], "left").join(anchors, "qid", "left")
    seed_mass = T.ratio(none("mass"), F.col("total"))
    coverage = T.ratio(none("covered"), none("anchors"))
    bridge = T.ratio(none("bridges"), none("picked"))
    return full.select("qid", "run", T.settled(0.40 * seed_mass + 0.25 * coverage + 0.20 * none("semantic") + 0.15 * bridge).alias("pre_score"))


def pair_distances(seeds: DataFrame, table: DataFrame, cap: int) -> DataFrame:
    """Distances of all pairs of one run's seeds (a handful each), ``cap`` beyond it."""
    a, b = seeds.select("qid", "run", F.col("node").alias("source")), seeds.select("qid", "run", "node")
    pairs = a.join(b, ["qid", "run"]).filter("source < node")
    near = table.select("qid", "source", "node", "dist")
    back = table.select("qid", F.col("node").alias("source"), F.col("source").alias("node"), "dist")
    d = near.union(back).groupBy("qid", "source", "node").agg(F.min("dist").alias("dist"))
    return pairs.join(d, ["qid", "source", "node"], "left").withColumn("dist", F.least(F.lit(cap), F.coalesce("dist", F.lit(cap))))


def dispersion(seeds: DataFrame, table: DataFrame, tau: int = 4) -> DataFrame:
    """Mean pairwise distance of a run's seeds over tau; 0 for one seed."""
    mean = pair_distances(seeds, table, tau).groupBy("qid", "run").agg((F.avg("dist") / tau).alias("x"))
    return seeds.select("qid", "run").distinct().join(mean, ["qid", "run"], "left").select("qid", "run", T.settled(F.coalesce("x", F.lit(0.0))).alias("dispersion"))


def connectivity(weights: DataFrame, near: DataFrame, spread: DataFrame, tau: int = 4) -> DataFrame:
    """Weighted nearness of the universe to the seeds, less half the dispersion, at least 0.

    weights: qid, node, weight; near: qid, run, node, dist (to the seed set, at most tau).
    """
    kept = near.join(weights.filter("weight > 0"), ["qid", "node"]).groupBy("qid", "run").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * (1 - F.least(F.col("dist"), F.lit(tau)) / tau)).alias("k"))
    return kept.join(spread, ["qid", "run"]).select("qid", "run", T.settled(F.greatest(F.lit(0.0), T.ratio(F.col("k"), F.col("w")) - 0.5 * F.col("dispersion"))).alias("connectivity"))


def pair_coverage(seeds: DataFrame, distances: DataFrame, tau: int = 4) -> DataFrame:
    """Share of (anchor, seed) pairs within tau of each other, and the spread of the share over anchors."""
    anchors = distances.select("qid", "source").distinct()
    pairs = seeds.select("qid", "run", "node").join(anchors, "qid").join(distances, ["qid", "source", "node"], "left")
    each = pairs.groupBy("qid", "run", "source").agg(F.avg(F.when(F.col("dist") <= tau, 1.0).otherwise(0.0)).alias("rate"))
    return each.groupBy("qid", "run").agg(T.settled(F.avg("rate")).alias("coverage"), T.settled(F.stddev_pop("rate")).alias("anchor_dispersion"))


def bridge_completeness(nodes: DataFrame, distances: DataFrame, tau: int = 4) -> DataFrame:
    """Share of anchor pairs with a run node within tau of both."""
    anchors = distances.select("qid", "source").distinct()
    all_pairs = anchors.alias("a").join(anchors.alias("b"), F.expr("a.qid = b.qid and a.source < b.source")).groupBy("a.qid").agg(F.count(F.lit(1)).alias("n")).select("qid", "n")
    near = nodes.select("qid", "run", "node").join(distances.filter(F.col("dist") <= tau), ["qid", "node"])
    met = near.alias("a").join(near.alias("b"), F.expr("a.qid = b.qid and a.run = b.run and a.node = b.node and a.source < b.source")).select("a.qid", "a.run", F.col("a.source").alias("l"), F.col("b.source").alias("r")).distinct().groupBy("qid", "run").agg(F.count(F.lit(1)).alias("k"))
    runs = nodes.select("qid", "run").distinct()
    return runs.join(met, ["qid", "run"], "left").join(all_pairs, "qid", "left").select("qid", "run", T.settled(T.ratio(F.coalesce("k", F.lit(0)), F.coalesce("n", F.lit(0)))).alias("completeness"))


def bridge_utility(nodes: DataFrame, distances: DataFrame, tau: int = 4) -> DataFrame:
    """Share of a run's nodes within tau of two anchors or more."""
    near = distances.filter(F.col("dist") <= tau).groupBy("qid", "node").agg(F.count_distinct("source").alias("k"))
    return nodes.select("qid", "run", "node").join(near, ["qid", "node"], "left").groupBy("qid", "run").agg(T.settled(F.avg(F.when(F.col("k") >= 2, 1.0).otherwise(0.0))).alias("utility"))


#: What lowers a run's score.
COSTS = ("redundancy", "dispersion")


def run_score(parts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of what a run has, less what it costs (redundancy, dispersion), over the sum of all weights.

    weights: any of semantic, anchor, structure, bridge, redundancy,
    pair_coverage, completeness, grounding, dispersion; negative ones count as none.
    """
    w = {k: max(0.0, x) for k, x in (weights or RUN_WEIGHTS).items()}
    total = sum(w.values()) or 1.0
    gains = sum((x * F.col(c) for c, x in w.items() if x and c not in COSTS), F.lit(0.0))
    costs = sum((x * F.col(c) for c, x in w.items() if x and c in COSTS), F.lit(0.0))
    return parts.withColumn("run_score", T.settled((gains - costs) / total))


def shortlist_runs(scored: DataFrame, score: str, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "run")).cast("long")
    return scored.withColumn("place", rank).filter(F.col("place") <= most)


def rerank_runs(head: DataFrame) -> DataFrame:
    """Light rerank of the head: .72 base + .12 semantic + .08 coverage + .08 bridge, each to 0..1."""
    mm = lambda c: T.min_max_vector(F.col(c), "qid")
    score = T.settled(0.72 * mm("base") + 0.12 * mm("semantic") + 0.08 * mm("coverage") + 0.08 * mm("bridge"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "run")).cast("long")
    return head.withColumn("score", score).withColumn("place", rank)


def surrogate_weights(scores: DataFrame, runs: int, most: int = 128) -> DataFrame:
    """Mean score of a node over all runs, absent ones as 0; the heaviest stay."""
    mean = scores.groupBy("qid", "node").agg(T.settled(F.sum("mass") / runs, 9).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("weight"), "node"))
    return mean.withColumn("r", rank).filter(F.col("r") <= most).drop("r")


def mean_positive(similarity: Column) -> Column:
    return F.avg(F.greatest(F.lit(0.0), similarity))


def semantic_redundancy(seeds: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mean positive pairwise similarity of a run's seeds that have a text (a handful each); 0 for one.

    tokens: qid, node, tokens. Token overlap stands in for the cosine of an encoder's vectors.
    """
    named = seeds.select("qid", "run", "node").join(tokens, ["qid", "node"])
    a, b = named.alias("a"), named.alias("b")
    pairs = a.join(b, F.expr("a.qid = b.qid and a.run = b.run and a.node < b.node"))
    mean = pairs.groupBy("a.qid", "a.run").agg(mean_positive(T.jaccard(F.col("a.tokens"), F.col("b.tokens"))).alias("x")).select("qid", "run", "x")
    return seeds.select("qid", "run").distinct().join(mean, ["qid", "run"], "left").select("qid", "run", T.settled(F.coalesce("x", F.lit(0.0))).alias("redundancy"))


def chunk_grounding(seeds: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Share of a run's linked seeds of which a linked node is in the run.

    links: qid, node, linked, in both directions; nodes: qid, run, node.
    """
    joined = seeds.select("qid", "run", "node").join(links, ["qid", "node"]).join(nodes.select("qid", "run", F.col("node").alias("linked"), F.lit(1).alias("inside")), ["qid", "run", "linked"], "left")
    each = joined.groupBy("qid", "run", "node").agg(F.max(F.coalesce("inside", F.lit(0))).alias("inside"))
    share = each.groupBy("qid", "run").agg(F.avg("inside").alias("x"))
    return seeds.select("qid", "run").distinct().join(share, ["qid", "run"], "left").select("qid", "run", T.settled(F.coalesce("x", F.lit(0.0))).alias("grounding"))


def fallback_pairs(pairs: DataFrame, chosen: DataFrame, seeds: DataFrame, anchors: DataFrame, most: int = 6) -> DataFrame:
    """All pairs of anchors and the chosen run's seeds, best seeds first, for questions without a pair."""
    bare = chosen.select("qid", "run").join(pairs.select("qid").distinct(), "qid", "left_anti")
    made = bare.join(seeds.select("qid", "run", "node", "seed_score"), ["qid", "run"]).join(anchors.select("qid", "source").distinct(), "qid")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("seed_score"), "source", "node"))
    return made.withColumn("rank", rank).filter(F.col("rank") <= most).select("qid", F.col("rank").cast("long").alias("rank"), "source", F.col("node").alias("seed"), "run")
