"""Corridors: paths between anchors and seeds, their scores, and the selection of text units."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def pair_shortlist(seeds: DataFrame, anchors: DataFrame, distances: DataFrame, align: DataFrame, similarity: DataFrame, tau: int = 4, most: int = 6) -> DataFrame:
    """Best (anchor, seed) pairs of a question: .30 alignment + .25 seed strength + .20 similarity + .15 nearness + .10 bridges.

    seeds: qid, run, node, seed_score; anchors: qid, source; align: qid, run,
    source, node, score (missing: 0); similarity: qid, node, sim. A pair keeps
    its best run.
    """
    cap = max(2, tau + 1)
    near = distances.select("qid", "source", "node", "dist")
    pairs = seeds.join(anchors.select("qid", "source").distinct(), "qid").join(near, ["qid", "source", "node"], "left").withColumn("dist", F.least(F.lit(cap), F.coalesce("dist", F.lit(cap))))
    w = Window.partitionBy("qid", "run", "node")
    others = F.sum(F.when(F.col("dist") < cap, 1).otherwise(0)).over(w) - F.when(F.col("dist") < cap, 1).otherwise(0)
    bridges = others / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1)
    full = pairs.withColumn("bridges", bridges).join(align, ["qid", "run", "source", "node"], "left").join(similarity, ["qid", "node"], "left")
    score = 0.30 * F.coalesce("score", F.lit(0.0)) + 0.25 * F.col("seed_score") + 0.20 * 0.5 * (F.coalesce("sim", F.lit(0.0)) + 1) + 0.15 * (1 - F.col("dist") / cap) + 0.10 * F.col("bridges")
    scored = full.withColumn("pair_score", T.settled(score))
    one = F.row_number().over(Window.partitionBy("qid", "source", "node").orderBy(F.desc("pair_score"), "run"))
    best = scored.withColumn("o", one).filter(F.col("o") == 1)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("pair_score"), "source", "node")).cast("long")
    return best.withColumn("rank", rank).filter(F.col("rank") <= most).select("qid", "rank", "source", F.col("node").alias("seed"), "run", "dist", "pair_score", T.settled(F.col("bridges")).alias("bridges"), T.settled(F.coalesce("score", F.lit(0.0))).alias("align"))


def shortest_paths(pairs: DataFrame, adjacent: DataFrame, distances: DataFrame, depth: int) -> DataFrame:
    """One shortest path of each pair (qid, rank, source, seed), the smallest parent at every step back.

    distances: from the sources. Walks back from the seed one level a round,
    so the plan has ``depth`` joins; paths are arrays from source to seed.
    """
    reach = pairs.join(distances.withColumnRenamed("node", "seed").select("qid", "source", "seed", F.col("dist").alias("d")), ["qid", "source", "seed"])
    open_ = reach.select("qid", "rank", "source", "seed", "d", F.col("seed").alias("at"), F.array("seed").alias("path"))
    done = open_.filter("d = 0")
    levels = distances.select("qid", "source", F.col("node").alias("dst"), "dist")
    for _ in range(depth):
        step = open_.filter("d > 0").join(adjacent.withColumnRenamed("src", "at"), ["qid", "at"]).join(levels, ["qid", "source", "dst"]).filter(F.col("dist") == F.col("d") - 1)
        open_ = step.groupBy("qid", "rank", "source", "seed", "d", "path").agg(F.min("dst").alias("at")).select("qid", "rank", "source", "seed", (F.col("d") - 1).alias("d"), "at", F.concat(F.array("at"), "path").alias("path"))
        done = done.union(open_.filter("d = 0"))
    return done.select("qid", "rank", "source", "seed", "path")


def payloads(paths: DataFrame, adjacent: DataFrame, pool: int = 4) -> DataFrame:
    """Text units of a corridor by role: on the path (main), next to it (support), and the fallback pool if the path has none.

    Long form: qid, corridor, role, pos, node.
    """
    steps = paths.select("qid", F.col("rank").alias("corridor"), "seed", F.posexplode("path").alias("pos", "node"))
    text = F.substring_index("node", "::", 1).isin("s", "c")
    main = steps.filter(text).select("qid", "corridor", F.lit("main").alias("role"), F.col("pos").cast("long").alias("pos"), "node")
    beside = steps.filter(~text).join(adjacent.withColumnRenamed("src", "node"), ["qid", "node"]).select("qid", "corridor", "pos", F.col("dst").alias("node")).filter(text)
    beside = beside.groupBy("qid", "corridor", "node").agg(F.min("pos").alias("at")).join(main.select("qid", "corridor", "node"), ["qid", "corridor", "node"], "left_anti")
    place = F.row_number().over(Window.partitionBy("qid", "corridor").orderBy("at", "node"))
    support = beside.withColumn("place", place).filter(F.col("place") <= pool).withColumn("pos", F.col("place").cast("long") - 1)
    bare = support.join(main.select("qid", "corridor").distinct().withColumn("has", F.lit(True)), ["qid", "corridor"], "left")
    return main.union(bare.select("qid", "corridor", F.when(F.col("has"), "support").otherwise("main").alias("role"), "pos", "node"))


def corridor_components(units: DataFrame, pairs: DataFrame, similarity: DataFrame, answer: float = 0.55, pair: float = 0.45) -> DataFrame:
    """Components of each corridor's score: structure, similarity, roles, purity, density, compactness and path completeness.

    answer, pair: least similarity (0..1) of a unit that is taken for an answer,
    and of one that bridges to it. One similarity stands for question and support.
    """
    sim = units.select("qid", "corridor", "node", "role").distinct().join(similarity, ["qid", "node"], "left").withColumn("s", 0.5 * (F.coalesce("sim", F.lit(0.0)) + 1))
    main, support = F.col("role") == "main", F.col("role") == "support"
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    parts = sim.groupBy("qid", "corridor").agg(
        F.count(F.when(main, 1)).alias("n_main"), F.count(F.when(support, 1)).alias("n_support"), F.count(F.lit(1)).alias("n"), T.settled(share("s"), 9).alias("semantic"),
        T.rounded(F.coalesce(F.avg(F.when(support, F.col("s"))), F.avg("s")), 9).alias("answer_side_density"), F.avg(F.when(support, (F.col("s") >= 0.35).cast("double"))).alias("useful"),
        F.count(F.when(F.col("s") >= answer, 1)).alias("answers"), F.count(F.when(support & (F.col("s") >= answer) & (F.col("s") >= pair), 1)).alias("kept"), F.array_sort(F.collect_set("node")).alias("nodes"),
    )
    one = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    joined = parts.join(pairs.select("qid", F.col("rank").alias("corridor"), "pair_score", F.col("align").alias("anchor"), F.col("bridges").alias("bridge")), ["qid", "corridor"])
    full = joined.withColumns({
        "structure": 0.6 * (F.col("n_main") > 0).cast("double") + 0.2 * F.least(F.lit(1.0), F.col("n_main") / 2) + 0.2 * F.least(F.lit(1.0), F.col("n_support") / 2),
        "answer": F.greatest("semantic", "anchor"), "bridge_purity": F.coalesce("useful", one(F.col("bridge"))), "support_set_compactness": 1.0 / (1 + F.greatest(F.lit(0), F.col("n_support") - 1)),
        "bridge_answer_pair_retention": F.col("kept") / F.greatest(F.lit(1), F.col("answers")), "span": F.col("n_support"), "support_density": F.col("n_support") / F.greatest(F.lit(1), F.col("n")),
    })
    chains = full.withColumns({
        "anchor_chain": F.greatest(F.col("anchor"), (F.col("n_main") > 0).cast("double")), "bridge_chain": F.greatest("bridge", "bridge_purity", "support_density"), "answer_chain": F.greatest("answer", "answer_side_density"),
    })
    answered = F.col("answer_chain") >= answer
    complete = (F.col("anchor_chain") >= 0.35) & (F.col("bridge_chain") >= 0.35) & answered & (F.col("bridge_answer_pair_retention") > 0)
    gap = F.least(F.lit(1.0), F.abs(F.col("answer_chain") - F.col("bridge_chain")))
    return chains.withColumns({
        "bridge_noise_ratio": one(1 - F.col("bridge_purity")), "path_complete_score": one(F.least("anchor_chain", "bridge_chain", "answer_chain")), "path_complete": complete,
        "incomplete_path_rate": (answered & ~complete).cast("double"), "chain_compactness": one(F.col("support_set_compactness") * (0.5 + 0.5 * F.col("bridge_answer_pair_retention")) * (1 - 0.4 * gap)),
    }).withColumn("path_complete_rate", F.when(F.col("path_complete"), 1.0).otherwise(F.col("path_complete_score")))


#: Settings of the shaping terms, all off by their weights.
SHAPING = {
    "compact": 0.0, "answer_preserve": 0.0, "bridge_purity": 0.0, "path_preserve": 0.0, "path_incomplete": 0.0, "path_compact": 0.0, "path_guarded": False, "path_compact_lite": False,
    "confidence_gated": False, "guarded_dataset": False, "guard_scale": 0.70, "guard_complete": 0.70, "guard_pair": 0.55, "guard_density": 0.62, "lite_scale": 0.65, "lite_overflow": 0.015,
    "lite_cap": 0.08, "density_min": 0.30, "light_boost": 0.65, "bridge_consistency": 0.55, "confidence": 0.62, "anchor_bridge_enough": 0.70, "density_cap": 0.72, "quota_cap": 0.40, "relax": 0.35,
}


def shaped(components: DataFrame, settings: dict | None = None) -> DataFrame:
    """Adds ``shaping``, what the enabled terms add to a corridor's base score, and whether paths and answers were preserved."""
    v = SHAPING | (settings or {})
    c = F.col
    total = v["compact"] * c("support_set_compactness")
    guard = (c("path_complete_score") >= v["guard_complete"]) & (c("bridge_answer_pair_retention") >= v["guard_pair"]) & (c("answer_side_density") >= v["guard_density"]) if v["path_guarded"] else F.lit(True)
    path_on = F.lit(v["path_preserve"] > 0)
    kept = path_on & c("path_complete") & guard
    bonus = v["path_preserve"] * c("path_complete_score") * (0.6 + 0.4 * c("bridge_answer_pair_retention")) * (v["guard_scale"] if v["path_guarded"] else 1.0)
    penalty = v["path_incomplete"] * c("incomplete_path_rate") * F.least(F.greatest(c("answer_chain"), F.lit(0.0)), F.lit(1.0))
    total = total + F.when(kept, bonus).when(path_on & ~c("path_complete"), -penalty).otherwise(0.0)
    if v["path_preserve"] > 0 and v["path_compact"] > 0:
        lite = v["path_compact_lite"]
        over = F.greatest(F.lit(0), c("span") - 3)
        total = total + v["path_compact"] * (c("chain_compactness") - 0.5) * (v["lite_scale"] if lite else 1.0) - F.least(F.lit(v["lite_cap"] if lite else 0.20), (v["lite_overflow"] if lite else 0.03) * over)
    preserve = F.lit(False)
    if v["answer_preserve"] > 0:
        scale, open_ = F.lit(1.0), F.lit(True)
        density = c("answer_side_density")
        if v["confidence_gated"]:
            open_ = (c("bridge_answer_pair_retention") >= v["bridge_consistency"]) & (density >= v["confidence"])
            scale = F.when(open_, v["light_boost"]).otherwise(1.0)
        if v["guarded_dataset"]:
            open_ = open_ & (density < v["density_cap"])
            scale = scale * F.when(0.5 * (c("anchor") + c("bridge")) >= v["anchor_bridge_enough"], v["relax"]).otherwise(1.0) * F.when(c("support_density") >= v["quota_cap"], v["relax"]).otherwise(1.0)
        gain = v["answer_preserve"] * (scale * density - 0.5 * F.greatest(F.lit(0.0), v["density_min"] - density))
        preserve = open_ & (gain > 0)
        total = total + F.when(preserve, gain).otherwise(0.0)
    total = total + v["bridge_purity"] * (c("bridge_purity") - 0.5 * c("bridge_noise_ratio"))
    return components.withColumns({"shaping": T.rounded(total, 9), "path_preserve_activation_rate": kept.cast("double"), "answer_preserve_activation_rate": preserve.cast("double")})


def corridor_scores(units: DataFrame, pairs: DataFrame, similarity: DataFrame, redundancy: float = 0.10, shaping: dict | None = None) -> DataFrame:
    """.45 structure + .25 similarity + .20 support similarity + .10 pair score + shaping terms, less redundancy x the
    largest Jaccard overlap with corridors of a higher base score."""
    joined = shaped(corridor_components(units, pairs, similarity), shaping)
    base = joined.withColumn("base", T.settled(0.45 * F.col("structure") + 0.45 * F.col("semantic") + 0.10 * F.col("pair_score") + F.col("shaping"), 9)).select("qid", "corridor", "base", "nodes")
    # a question has a handful of corridors, so each meets those before it
    a, b = base.alias("a"), base.select("qid", F.col("corridor").alias("o"), F.col("base").alias("ob"), F.col("nodes").alias("on")).alias("b")
    ahead = (F.col("b.ob") > F.col("a.base")) | ((F.col("b.ob") == F.col("a.base")) & (F.col("b.o") < F.col("a.corridor")))
    overlap = a.join(b, (F.col("a.qid") == F.col("b.qid")) & ahead, "left").groupBy("a.qid", "a.corridor").agg(F.coalesce(F.max(T.jaccard(F.col("a.nodes"), F.col("b.on"))), F.lit(0.0)).alias("overlap"))
    scored = base.join(overlap, ["qid", "corridor"]).withColumn("score", T.settled(F.col("base") - redundancy * F.col("overlap")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "corridor")).cast("long")
    return scored.withColumn("place", rank).select("qid", "corridor", "place", T.settled(F.col("base")).alias("base"), T.settled(F.col("overlap")).alias("overlap"), "score")


def _overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def coverage_greedy(corridors: DataFrame, gain: float = 0.35, redundancy: float = 0.20) -> DataFrame:
    """Order a question's corridors one by one: base + gain x new units' share - redundancy x overlap with those chosen.

    corridors: qid, corridor, base, nodes. A question has a handful of them.
    """
    grouped = corridors.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("corridor", "base", "nodes"))).alias("c"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for qid, c in b[["qid", "c"]].itertuples(index=False):
                rest = [(x["corridor"], x["base"], set(x["nodes"])) for x in c]
                seen: set = set()
                chosen: list[set] = []
                while rest:
                    value = [x[1] + gain * (len(x[2] - seen) / max(1, len(x[2]))) - redundancy * max((_overlap(x[2], y) for y in chosen), default=0.0) for x in rest]
                    k = max(range(len(rest)), key=lambda i: (value[i], -i))
                    name, _, nodes = rest.pop(k)
                    out.append((qid, len(chosen) + 1, name, T.settled_number(value[k])))
                    chosen.append(nodes)
                    seen |= nodes
            yield pd.DataFrame(out, columns=["qid", "place", "corridor", "value"])

    return grouped.mapInPandas(run, "qid long, place long, corridor long, value double")


def trim(nodes: DataFrame, edges: DataFrame, share: float = 0.5) -> DataFrame:
    """Drop components without an anchor, then leaves one by one while the anchors stay together and enough seeds remain.

    nodes: qid, node, anchor, seed; edges: qid, src, dst (one question's selection, some hundred nodes).
    """
    grouped = nodes.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("node", "anchor", "seed"))).alias("n"))
    links = edges.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(qid, x) for qid, n, e in b[["qid", "n", "e"]].itertuples(index=False) for x in trimmed(n, [] if e is None else e, share)]
            yield pd.DataFrame(out, columns=["qid", "node"])

    return grouped.join(links, "qid", "left").mapInPandas(run, "qid long, node string")


def trimmed(nodes: list, edges: list, share: float) -> list[str]:
    near: dict[str, set] = {x["node"]: set() for x in nodes}
    for e in edges:
        if e["src"] in near and e["dst"] in near and e["src"] != e["dst"]:
            near[e["src"]].add(e["dst"])
            near[e["dst"]].add(e["src"])
    anchors, seeds = {x["node"] for x in nodes if x["anchor"]}, {x["node"] for x in nodes if x["seed"]}
    least = round(share * len(seeds))

    def reach(start: str) -> set:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    together = bool(anchors) and anchors <= reach(min(anchors))
    changed = together  # a leaf never joins two anchors, so anchors that hang together stay so
    while changed:
        changed = False
        for x in sorted(near):
            if len(near[x]) == 1 and x not in anchors and not (x in seeds and len(seeds & near.keys()) <= least):
                near[near.pop(x).pop()].discard(x)
                changed = True
    kept: set = set()
    for a in sorted(anchors):
        kept |= reach(a)
    return sorted(kept) if anchors else sorted(near)


def entity_chunk_scores(entities: DataFrame, support: DataFrame, mix: float = 0.35, most: int = 20) -> DataFrame:
    """Fold a unit's entities in rank order: each lifts the score to (1 - mix) x before + mix x entity x max(.20, 1 - .06 r)."""
    keys = ["qid", "token"] if "qid" in support.columns else ["token"]
    hits = entities.select("qid", "token", "sim", "rank").join(support.select(*keys, "unit", F.col("rank").alias("r")), keys)
    lift = F.col("sim") * F.greatest(F.lit(0.20), 1 - 0.06 * F.col("r"))
    listed = hits.groupBy("qid", "unit").agg(F.array_sort(F.collect_list(F.struct("rank", "token", lift.alias("lift")))).alias("l"))
    score = F.aggregate("l", F.lit(0.0), lambda s, x: F.greatest(s, (1 - mix) * s + mix * x["lift"]))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "unit")).cast("long")
    return listed.withColumn("score", T.rounded(score, 6)).withColumn("rank", rank).filter(F.col("rank") <= most).select("qid", "rank", "unit", "score")


def unit_features(selected: DataFrame, units: DataFrame, ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Features of each selected unit: best corridor, roles, overlap with the question, locality, base score.

    selected: qid, pos (from 0), node, text, score; units: corridor payloads; ranked: corridors with place and score.
    """
    # support units lie next to a path node that is no text, so all of them are connector-adjacent
    roles = units.join(ranked.select("qid", "corridor", "place", F.col("score").alias("corridor_score")), ["qid", "corridor"])
    at = Window.partitionBy("qid", "corridor", "role").orderBy("pos", "node")
    placed = roles.join(selected.select("qid", "node"), ["qid", "node"], "left_semi").withColumn("k", F.row_number().over(at) - 1)
    main, support = F.col("role") == "main", F.col("role") == "support"
    local = F.when(main, 1.0).otherwise(0.75) / (F.col("place") * (F.col("k") + 1))
    best = placed.groupBy("qid", "node").agg(F.min("place").alias("best_rank"), F.max("corridor_score").alias("best_score"), F.max(main).alias("is_main"), F.max(support).alias("is_support"), F.max(support).alias("is_connector"), F.max(local).alias("local"), F.count_distinct("corridor").alias("corridors"))
    asked = questions.select("qid", F.array_distinct(T.content_tokens(F.col("text"))).alias("asked"))
    full = selected.join(best, ["qid", "node"], "left").join(asked, "qid")
    false = lambda c: F.coalesce(F.col(c), F.lit(False))
    return full.select(
        "qid", "pos", "node", "text", F.coalesce("best_rank", F.lit(10**9)).cast("long").alias("best_rank"), F.round(F.coalesce("best_score", F.lit(0.0)), 6).alias("best_score"), false("is_main").alias("is_main"), false("is_support").alias("is_support"), false("is_connector").alias("is_connector"),
        F.coalesce("corridors", F.lit(0)).cast("long").alias("corridors"), F.size(F.array_intersect("asked", T.content_tokens(F.col("text")))).cast("long").alias("overlap"),
        T.settled(F.greatest(1.0 / (F.col("pos") + 1), F.coalesce("local", F.lit(0.0)))).alias("locality"), T.settled(F.col("score")).alias("base"),
    )


#: Weights of the head correction of corridors; redundancy counts against them.
CORRIDOR_HEAD = {"score": 0.75, "align": 0.10, "support": 0.06, "bridge": 0.05, "semantic": 0.04}


def correct_corridors(ranked: DataFrame, head: int = 3, redundancy: float = 0.05) -> DataFrame:
    """Re-score a question's best corridors by min-maxed features; the rest keeps its order behind them.

    ranked: qid, corridor, place, score, align, support, bridge, semantic, overlap.
    """
    mm = lambda c: T.min_max_vector(F.col(c).cast("double"), "qid")
    top = ranked.filter(F.col("place") <= head)
    score = sum((w * mm(c) for c, w in CORRIDOR_HEAD.items()), F.lit(0.0)) - redundancy * mm("overlap")
    order = Window.partitionBy("qid").orderBy(F.desc("corrected"), "place")
    first = top.withColumn("corrected", T.rounded(score, 9)).withColumn("new", F.row_number().over(order).cast("long"))
    rest = ranked.filter(F.col("place") > head).select("qid", "corridor", F.col("place").alias("new"))
    return first.select("qid", "corridor", "new").union(rest).withColumnRenamed("new", "place")


def local_nodes(pairs: DataFrame, from_anchor: DataFrame, from_seed: DataFrame, paths: DataFrame, similarity: DataFrame, most: int = 160) -> DataFrame:
    """The nodes around each pair: those near its anchor or its seed and those on its path, the best ``most`` by nearness
    and similarity, and the ends.

    from_anchor, from_seed: qid, source, node, dist, up to the hops of the refinement.
    """
    named = pairs.select("qid", F.col("rank").alias("corridor"), "source", "seed")
    near = named.join(from_anchor, ["qid", "source"]).select("qid", "corridor", "node", "dist")
    near = near.union(named.join(from_seed.withColumnRenamed("source", "seed"), ["qid", "seed"]).select("qid", "corridor", "node", "dist"))
    far = paths.select("qid", F.col("rank").alias("corridor"), F.explode("path").alias("node"), F.lit(10**6).alias("dist"))
    each = near.union(far).groupBy("qid", "corridor", "node").agg(F.min("dist").alias("dist")).join(similarity, ["qid", "node"], "left")
    value = T.rounded(0.70 / (1 + F.col("dist")) + 0.15 * (F.coalesce("sim", F.lit(0.0)) + 1), 9)
    ends = named.select("qid", "corridor", F.explode(F.array("source", "seed")).alias("node"), F.lit(True).alias("end")).distinct()
    rank = F.row_number().over(Window.partitionBy("qid", "corridor").orderBy(F.desc("value"), "node"))
    placed = each.withColumn("value", value).withColumn("r", rank).join(ends, ["qid", "corridor", "node"], "left")
    return placed.filter((F.col("r") <= most) | F.col("end")).select("qid", "corridor", "node", F.round(0.5 * (F.coalesce("sim", F.lit(0.0)) + 1), 9).alias("semantic"))


def local_walk(nodes: list[str], edges: list, anchor: str, seed: str, hops: int, steps: int = 80, alpha: float = 0.15, tolerance: float = 1e-6) -> tuple[dict, dict]:
    """PageRank from the anchor and capped distances to the seed in one small graph."""
    at = {x: i for i, x in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for e in edges:
        m[at[e["dst"]], at[e["src"]]] = 1.0
    degree = m.sum(0)
    move = np.divide(m, degree, out=np.zeros_like(m), where=degree > 0)
    start = np.zeros(len(nodes))
    start[at[anchor]] = 1.0
    mass = start.copy()
    for _ in range(steps):
        new = (1 - alpha) * (move @ mass) + (alpha + (1 - alpha) * mass[degree == 0].sum()) * start
        done = abs(new - mass).sum() < tolerance * len(nodes)
        mass = new
        if done:
            break
    dist, ring = {seed: 0}, [at[seed]]
    for d in range(1, hops + 1):
        ring = sorted({int(j) for i in ring for j in np.flatnonzero(m[:, i])} - {at[x] for x in dist})
        dist.update({nodes[j]: d for j in ring})
    return dict(zip(nodes, mass.tolist(), strict=True)), {x: dist.get(x, hops) for x in nodes}


def _spread(values: dict) -> dict:
    low, high = min(values.values()), max(values.values())
    return {k: (v - low) / (high - low) if high > low else float(high > 0) for k, v in values.items()}


def refine(nodes: DataFrame, adjacent: DataFrame, pairs: DataFrame, mass: DataFrame, hops: int = 5, top: int = 20) -> DataFrame:
    """Local refinement of each pair in the graph of its nodes: .40 local walk + .25 nearness to the seed + .20 score in the
    run + .15 similarity, each to 0..1; the best ``top``: qid, corridor, place, node, score.

    nodes: as ``local_nodes`` gives them (some hundred of a pair); mass: qid, run, node, mass.
    """
    named = nodes.select("qid", "corridor", "node")
    inner = adjacent.join(named.withColumnRenamed("node", "src"), ["qid", "src"]).join(named.withColumnRenamed("node", "dst"), ["qid", "corridor", "dst"])
    links = inner.groupBy("qid", "corridor").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    ends = pairs.select("qid", F.col("rank").alias("corridor"), "source", "seed", "run")
    scored = nodes.join(ends, ["qid", "corridor"]).join(mass, ["qid", "run", "node"], "left")
    lists = scored.groupBy("qid", "corridor", "source", "seed").agg(F.array_sort(F.collect_list(F.struct("node", "semantic", F.coalesce("mass", F.lit(0.0)).alias("mass")))).alias("n"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for qid, corridor, anchor, seed, n, e in b[["qid", "corridor", "source", "seed", "n", "e"]].itertuples(index=False):
                walk, dist = local_walk([x["node"] for x in n], [] if e is None else e, anchor, seed, hops)
                parts = [_spread(walk), _spread({k: 1 - d / hops for k, d in dist.items()}), _spread({x["node"]: x["mass"] for x in n}), _spread({x["node"]: x["semantic"] for x in n})]
                value = {k: round(0.40 * parts[0][k] + 0.25 * parts[1][k] + 0.20 * parts[2][k] + 0.15 * parts[3][k], 9) for k in walk}
                best = sorted(value, key=lambda k: (-value[k], k))[:top]
                out += [(qid, corridor, i + 1, k, round(value[k], 6)) for i, k in enumerate(best)]
            yield pd.DataFrame(out, columns=["qid", "corridor", "place", "node", "score"])

    return lists.join(links, ["qid", "corridor"], "left").mapInPandas(run, "qid long, corridor long, place long, node string, score double")


def merge_refined(refined: DataFrame, adjacent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A question's text units by their best refined score, and the graph that all refined nodes induce."""
    text = F.substring_index("node", "::", 1).isin("s", "c")
    units = refined.filter(text).groupBy("qid", "node").agg(F.max("score").alias("score"))
    keep = refined.select("qid", "node").distinct()
    one = adjacent.join(keep.withColumnRenamed("node", "src"), ["qid", "src"], "left_semi")
    return units, one.join(keep.withColumnRenamed("node", "dst"), ["qid", "dst"], "left_semi").select("qid", "src", "dst")
