"""Anchors and proposals: where a question enters the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sizes import small


def question_tokens(questions: DataFrame) -> DataFrame:
    """Distinct content tokens of each question with their first position."""
    pos = questions.select("qid", F.posexplode(T.content_tokens(F.col("text"))).alias("pos", "token"))
    return pos.groupBy("qid", "token").agg(F.min("pos").alias("pos"))


def document_tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("token"))


def anchor_score(freq: Column, degree: Column) -> Column:
    return F.lit(0.75) / (1 + freq) + F.lit(0.25) / (1 + F.lit(0.15) * F.greatest(F.lit(0), degree - 1))


def lexical_anchors(questions: DataFrame, support: DataFrame, most: int = 5) -> DataFrame:
    """support(token, freq, degree): the rarest question tokens that are entities.

    The question side is small and the support table is keyed by token, so the
    join keeps only the questions' tokens of it.
    """
    scored = question_tokens(questions).join(support, "token").withColumn("score", anchor_score(F.col("freq"), F.col("degree")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "freq", "degree", "pos"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select("qid", "rank", "token", "freq", "degree", "score")


def token_support(tokens: DataFrame) -> DataFrame:
    """Document frequency of each token; in this layer it is the degree as well. One aggregation with map-side sums."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).withColumn("degree", F.col("freq"))


def fallback_anchors(questions: DataFrame, anchors: DataFrame, support: DataFrame, most: int = 5) -> DataFrame:
    """Entities of the highest degree, for questions without an anchor."""
    top = support.orderBy(F.desc("degree"), "token").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("degree"), "token")).cast("long")  # ``most`` rows
    return questions.join(anchors, "qid", "left_anti").select("qid").crossJoin(F.broadcast(top.withColumn("rank", rank))).select("qid", "rank", "token")


def hybrid_anchors(questions: DataFrame, anchors: DataFrame, semantic: DataFrame, support: DataFrame, most: int = 5, add: int = 2, alias_boost: float = 0.10) -> DataFrame:
    """Lexical anchors and up to ``add`` entities by .70 similarity + boost x alias overlap + .20 rarity.

    semantic(qid, token, sim). Lexical anchors come first where the list is cut.
    """
    asked = question_tokens(questions).select("qid", "token", F.lit(1.0).alias("overlap"))
    scored = semantic.join(support, "token").join(asked, ["qid", "token"], "left")
    score = 0.70 * 0.5 * (F.col("sim") + 1) + alias_boost * F.coalesce("overlap", F.lit(0.0)) + 0.20 / (1 + F.col("freq"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "token")
    scanned = scored.withColumn("score", score).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max(6 * add, 24))
    new = scanned.join(anchors.select("qid", "token"), ["qid", "token"], "left_anti").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= add)
    pool = anchors.select("qid", "token", F.lit(1).alias("lexical"), F.lit(0.0).alias("sim"), F.col("rank").alias("o")).union(new.select("qid", "token", F.lit(0), "sim", F.col("k").cast("long")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("lexical"), F.desc("sim"), "o")).cast("long")
    return pool.withColumn("rank", rank).filter(F.col("rank") <= most).select("qid", "rank", "token", (F.col("lexical") == 0).alias("added"))


def proposals(anchors: DataFrame, tokens: DataFrame, most: int = 5) -> DataFrame:
    """Documents by the sum of their anchors' scores: the context of each question."""
    hit = tokens.join(small(anchors.select("qid", "token", "score")), "token")
    summed = hit.groupBy("qid", "doc_id").agg(T.rounded(F.sum("score"), 9).alias("score"), F.count(F.lit(1)).alias("n_anchors"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")).cast("long")
    return summed.withColumn("rank", rank).filter(F.col("rank") <= most)


def lexical_proposals(distances: DataFrame, scores: DataFrame, tau: int = 4, local: int = 20) -> DataFrame:
    """Per anchor: nodes by .90 score + .10 nearness; proposal score max(base, .05) + .02/(rank + 1)."""
    joined = distances.join(scores, ["qid", "node"]).withColumn("base", 0.90 * F.col("score") + 0.10 * (1 - F.least(F.col("dist"), F.lit(tau)) / tau))
    place = F.row_number().over(Window.partitionBy("qid", "source").orderBy(F.desc("base"), "node"))
    kept = joined.withColumn("place", place).filter(F.col("place") <= local).withColumn("rank", F.col("place").cast("long") - 1)
    return kept.select("qid", "source", "node", "rank", (F.greatest(F.col("base"), F.lit(0.05)) + 0.02 / (F.col("rank") + 1)).alias("score"))


def lazy_union(proposed: DataFrame, anchors: DataFrame, most: int = 64) -> DataFrame:
    """One candidate list per question: anchors first, then nodes that several anchors propose, then the rest by score."""
    merged = proposed.groupBy("qid", "node").agg(F.max("score").alias("score"), F.count_distinct("source").alias("votes"))
    named = anchors.select("qid", F.col("node"), F.lit(1).alias("anchor"))
    pool = merged.join(named, ["qid", "node"], "full_outer").select("qid", "node", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), F.coalesce("anchor", F.lit(0)).alias("anchor"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("anchor"), F.desc(F.col("votes") >= 2), F.desc("score"), "node")).cast("long")
    return pool.withColumn("rank", rank).filter(F.col("rank") <= most)


def bridge_candidates(distances: DataFrame, semantic: DataFrame, degree: DataFrame, tau: int = 4, per_pair: int = 8, most: int = 48) -> DataFrame:
    """Nodes within tau of both anchors of a pair: .45 similarity + .35 path consistency + .20 normalized degree."""
    a, b = distances.alias("a"), distances.alias("b")
    pair = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.node") == F.col("b.node")) & (F.col("a.source") < F.col("b.source"))).select(
        F.col("a.qid").alias("qid"), F.col("a.node").alias("node"), F.col("a.source").alias("left"), F.col("b.source").alias("right"), F.col("a.dist").alias("da"), F.col("b.dist").alias("db")
    ).filter((F.col("node") != F.col("left")) & (F.col("node") != F.col("right")) & (F.col("da") <= tau) & (F.col("db") <= tau))
    top = degree.groupBy("qid").agg(F.max("degree").alias("top"))
    full = pair.join(semantic, ["qid", "node"], "left").join(degree, ["qid", "node"]).join(top, "qid")
    score = 0.45 * 0.5 * (F.coalesce("sim", F.lit(0.0)) + 1) + 0.35 * (1 - (F.col("da") + F.col("db")) / (2.0 * tau)) + 0.20 * F.col("degree") / F.col("top")
    scored = full.withColumn("score", T.rounded(score, 9))
    within = F.row_number().over(Window.partitionBy("qid", "left", "right").orderBy(F.desc("score"), "node"))
    best = scored.withColumn("r", within).filter(F.col("r") <= per_pair).groupBy("qid", "node").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("pairs"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "node")).cast("long")
    return best.withColumn("rank", rank).filter(F.col("rank") <= most)


def graph_reserve(distances: DataFrame, degree: DataFrame, most: int = 32) -> DataFrame:
    """Nodes near an anchor: .80/(1 + distance) + .20 min(1, degree/20), best over anchors."""
    near = distances.filter("dist > 0").groupBy("qid", "node").agg(F.min("dist").alias("dist")).join(degree, ["qid", "node"])
    score = T.rounded(0.80 / (1 + F.col("dist")) + 0.20 * F.least(F.lit(1.0), F.col("degree") / 20), 9)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "node")).cast("long")
    return near.withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= most).select("qid", "rank", "node", "dist", "score")


def reduced_edges(adjacent: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges whose both ends are kept: two semi-joins."""
    k = keep.select("qid", F.col("node")).distinct()
    one = adjacent.join(k.withColumnRenamed("node", "src"), ["qid", "src"], "left_semi")
    return one.join(k.withColumnRenamed("node", "dst"), ["qid", "dst"], "left_semi").select("qid", "src", "dst")


def path_nodes(targets: DataFrame, distances: DataFrame, adjacent: DataFrame, tau: int) -> DataFrame:
    """Nodes of all shortest paths from sources to targets (qid, source, node) that are at most tau apart.

    The search's distances make it a graph of parents: from the farthest level
    down, a node's parents are its neighbours one step nearer to the source, so
    each node enters once, however many paths lead through it.
    """
    ends = targets.select("qid", "source", "node").join(distances, ["qid", "source", "node"]).filter(F.col("dist") <= tau)
    level, found = None, []
    for d in range(tau, -1, -1):
        here = ends.filter(F.col("dist") == d).select("qid", "source", "node")
        if level is not None:
            beside = level.withColumnRenamed("node", "src").join(adjacent, ["qid", "src"]).select("qid", "source", F.col("dst").alias("node"))
            here = here.union(beside.join(distances.filter(F.col("dist") == d), ["qid", "source", "node"], "left_semi"))
        level = here.distinct()
        found.append(level)
    return reduce(DataFrame.union, found)


def reduced_nodes(adjacent: DataFrame, sources: DataFrame, proposed: DataFrame, distances: DataFrame, degree: DataFrame, relation: Column, tau: int = 4, reserve: int = 15, cap: int = 30_000) -> DataFrame:
    """Nodes of the reduced graph of each question: anchors, proposals, the shortest paths to each anchor's first
    proposals, and relations beside them; by priority where there are more than ``cap``, anchors always.

    proposed: qid, source, node, rank (from 0), score; relation: whether a ``node`` is one.
    """
    paths = path_nodes(proposed.filter(F.col("rank") < max(1, reserve // 2)), distances, adjacent, tau)
    zero = F.lit(0.0)
    kept = sources.select("qid", F.col("source").alias("node"), F.lit(1).alias("must"), zero.alias("score")).union(proposed.select("qid", "node", F.lit(0), "score")).union(paths.select("qid", "node", F.lit(0), zero))
    kept = kept.groupBy("qid", "node").agg(F.max("must").alias("must"), F.max("score").alias("score"))
    beside = kept.select("qid", F.col("node").alias("src")).join(adjacent, ["qid", "src"]).select("qid", F.col("dst").alias("node")).filter(relation).distinct()
    kept = kept.union(beside.join(kept, ["qid", "node"], "left_anti").select("qid", "node", F.lit(0), zero))
    value = T.rounded(F.col("score") + 0.02 * F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / 25), 9)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("must"), F.desc("value"), "node"))
    return kept.join(degree, ["qid", "node"], "left").withColumn("value", value).withColumn("place", place).filter((F.col("place") <= cap) | (F.col("must") == 1)).select("qid", "node", "must", "value")


def cache_reserve(sources: DataFrame, forward: DataFrame, back: DataFrame, adjacent: DataFrame, degree: DataFrame, most: int = 15) -> DataFrame:
    """Reserve of each (qid, source) from support lists and neighbours, without a walk.

    Linked units count 1 - .04 rank, what they link back to .82 - .06 rank -
    .04 rank', plain neighbours .35 + .15 min(1, degree/20); the best of each
    node. forward and back: qid, node, linked, rank (from 0).
    """
    wide = max(2 * most, 8)
    one = sources.withColumnRenamed("source", "node").join(forward, ["qid", "node"]).filter(F.col("rank") < wide).select("qid", F.col("node").alias("source"), F.col("linked").alias("node"), F.col("rank").alias("r"))
    near = one.select("qid", "source", "node", (1.0 - 0.04 * F.col("r")).alias("score"))
    two = one.join(back.filter("rank < 2"), ["qid", "node"]).filter(F.col("linked") != F.col("source")).select("qid", "source", F.col("linked").alias("node"), (0.82 - 0.06 * F.col("r") - 0.04 * F.col("rank")).alias("score"))
    beside = sources.join(adjacent.withColumnRenamed("src", "source"), ["qid", "source"]).select("qid", "source", F.col("dst").alias("node")).join(degree, ["qid", "node"]).select("qid", "source", "node", (0.35 + 0.15 * F.least(F.lit(1.0), F.col("degree") / 20)).alias("score"))
    best = near.union(two).union(beside).groupBy("qid", "source", "node").agg(F.round(F.max("score"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid", "source").orderBy(F.desc("score"), "node")).cast("long")
    return best.withColumn("rank", rank).filter(F.col("rank") <= most)


#: What each proposal mode scales the caps by, and its least values.
LEVELS = {
    "off": {"entity": (1.0, 1), "chunk": (1.0, 1), "reserve": (1.0, 1), "support": 4, "mix": (0.0, 1), "local": 1.0, "hops": None},
    "mild": {"entity": (0.95, 8), "chunk": (0.95, 6), "reserve": (0.90, 6), "support": 4, "mix": (0.6, 2), "local": 0.90, "hops": 3},
    "medium": {"entity": (0.85, 6), "chunk": (0.80, 5), "reserve": (0.75, 5), "support": 3, "mix": (0.5, 2), "local": 0.75, "hops": 3},
    "aggressive": {"entity": (0.70, 5), "chunk": (0.65, 4), "reserve": (0.60, 4), "support": 2, "mix": (0.35, 1), "local": 0.60, "hops": 2},
}


def proposal_level(mode: str, entities: int = 16, chunks: int = 16, reserve: int = 8, local: int = 40, hops: int = 4) -> dict[str, int]:
    """Caps of a proposal mode; an unknown mode is ``off``."""
    level = LEVELS.get(str(mode or "off").strip().lower(), LEVELS["off"])
    cap = lambda name, top: max(level[name][1], round(level[name][0] * top))
    mix = max(1, min(reserve, 3)) if level["mix"][0] == 0 else cap("mix", reserve)
    return {
        "entity": cap("entity", entities), "chunk": cap("chunk", chunks), "reserve": cap("reserve", reserve), "support": level["support"], "mix": mix,
        "entity_pool": max(entities, 2 * entities), "chunk_pool": max(chunks, 2 * chunks), "local": max(8, round(level["local"] * max(8, local))),
        "hops": hops if level["hops"] is None else max(1, min(hops, level["hops"])),
    }


def leveled_proposals(scores: DataFrame, distances: DataFrame, reserve: DataFrame, links: DataFrame, level: dict[str, int], shared: int = 24, fallback: int = 16) -> DataFrame:
    """Proposals of one mode: per anchor high-confidence nodes, semantic nodes and the reserve; nodes that several anchors
    are sure of; and the best of the rest of all.

    scores: qid, node, kind (entity or chunk), score; distances: qid, source,
    node, dist; reserve: qid, source, node, rank, score; links: qid, node,
    linked, rank (from 0). Returns qid, node, part (anchor, shared or global),
    votes, score, one row per node and part.
    """
    first = lambda *keys: Window.partitionBy(*keys)
    pool = F.row_number().over(first("qid", "kind").orderBy(F.desc("score"), "node"))
    pooled = scores.withColumn("o", pool).filter((F.col("o") <= level["entity_pool"]) & (F.col("kind") == "entity") | (F.col("o") <= level["chunk_pool"]) & (F.col("kind") == "chunk"))
    sources = distances.select("qid", "source").distinct()
    near = distances.select("qid", "source", "node", F.least(F.col("dist"), F.lit(level["hops"])).alias("d"))
    ranked = pooled.join(sources, "qid").join(near, ["qid", "source", "node"], "left")
    value = T.rounded(0.90 * F.col("score") + 0.10 * F.coalesce(1 - F.col("d") / level["hops"], F.lit(0.0)), 9)
    ranked = ranked.withColumn("value", value).withColumn("r", F.row_number().over(first("qid", "source", "kind").orderBy(F.desc("value"), "node")))
    semantic = ranked.filter((F.col("r") <= level["entity"]) & (F.col("kind") == "entity") | (F.col("r") <= level["chunk"]) & (F.col("kind") == "chunk"))
    held = reserve.filter(F.col("rank") <= level["reserve"]).select("qid", "source", "node", F.col("rank").alias("r"), F.col("score").alias("sure"))
    head = semantic.filter((F.col("kind") == "entity") & (F.col("r") <= max(3, level["entity"] // 2)))
    linked = head.select("qid", "source", "node", F.col("r").alias("e")).join(links.filter(F.col("rank") < level["support"]), ["qid", "node"]).select("qid", "source", F.col("linked").alias("node"), "e", F.col("rank").alias("k"))
    sure = linked.select("qid", "source", "node", F.lit(0).alias("g"), "e", "k").union(held.select("qid", "source", "node", F.lit(1), "r", F.lit(0).cast("long")))
    sure = sure.groupBy("qid", "source", "node").agg(F.min(F.struct("g", "e", "k")).alias("o"))
    sure = sure.withColumn("p", F.row_number().over(first("qid", "source").orderBy("o", "node"))).filter(F.col("p") <= max(2, level["reserve"]))
    # one list for each anchor: itself, sure nodes, semantic ones, the reserve
    lists = sources.select("qid", "source", F.col("source").alias("node"), F.lit(0).alias("g"), F.lit(0).alias("r"))
    lists = lists.union(sure.select("qid", "source", "node", F.lit(1), "p")).union(semantic.select("qid", "source", "node", F.when(F.col("kind") == "entity", 2).otherwise(3), "r")).union(held.select("qid", "source", "node", F.lit(4), F.col("r").cast("int")))
    merged = lists.groupBy("qid", "source", "node").agg(F.min(F.struct("g", "r")).alias("o"))
    merged = merged.withColumn("rank", F.row_number().over(first("qid", "source").orderBy("o", "node"))).filter(F.col("rank") <= level["local"])
    floor = merged.join(sure.select("qid", "source", "node", F.lit(0.10).alias("floor")), ["qid", "source", "node"], "left").join(held.select("qid", "source", "node", F.lit(0.05).alias("low")), ["qid", "source", "node"], "left")
    best = floor.join(scores.select("qid", "node", "score"), ["qid", "node"], "left")
    base = F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("floor", "low", F.lit(0.0))) + 0.02 / F.col("rank")
    anchors = best.groupBy("qid", "node").agg(F.round(F.max(base), 6).alias("score"), F.count(F.lit(1)).alias("votes")).select("qid", "node", F.lit("anchor").alias("part"), "votes", "score")
    votes = sure.join(held.select("qid", "source", "node", "sure"), ["qid", "source", "node"], "left").join(scores.select("qid", "node", "score"), ["qid", "node"], "left")
    votes = votes.groupBy("qid", "node").agg(F.count(F.lit(1)).alias("votes"), F.round(F.max(F.coalesce("sure", "score", F.lit(0.0))), 6).alias("score"))
    some = F.max(F.col("votes") >= 2).over(first("qid"))
    agreed = votes.withColumn("some", some).filter((F.col("votes") >= 2) | ~F.col("some"))
    agreed = agreed.withColumn("o", F.row_number().over(first("qid").orderBy(F.desc(F.when(F.col("some"), F.col("votes")).otherwise(0)), F.desc("score"), "node"))).filter(F.col("o") <= shared)
    rest = pooled.join(agreed.select("qid", "node"), ["qid", "node"], "left_anti")
    rest = rest.withColumn("o", F.row_number().over(first("qid").orderBy(F.desc("score"), "node"))).filter(F.col("o") <= fallback)
    return anchors.union(agreed.select("qid", "node", F.lit("shared"), "votes", "score")).union(rest.select("qid", "node", F.lit("global"), F.lit(0).cast("long"), F.round("score", 6)))


def with_bridges(proposed: DataFrame, bridges: DataFrame, sources: DataFrame, local: int = 48) -> DataFrame:
    """Bridge candidates behind every anchor's list, cut at the local cap; a node keeps its larger score.

    proposed: qid, source, node, rank (from 0), score; bridges: qid, node, rank, score.
    """
    added = bridges.select("qid", "node", F.col("rank").alias("r"), F.col("score").alias("bridge")).join(sources.select("qid", "source").distinct(), "qid")
    both = proposed.select("qid", "source", "node", F.lit(0).alias("g"), F.col("rank").cast("long").alias("r"), "score", F.lit(None).cast("double").alias("bridge")).unionByName(added.select("qid", "source", "node", F.lit(1).alias("g"), F.col("r").cast("long").alias("r"), F.lit(None).cast("double").alias("score"), "bridge"))
    merged = both.groupBy("qid", "source", "node").agg(F.min(F.struct("g", "r")).alias("o"), F.max(F.greatest("score", "bridge")).alias("score"))
    place = F.row_number().over(Window.partitionBy("qid", "source").orderBy("o", "node"))
    return merged.withColumn("place", place).filter(F.col("place") <= max(8, local)).select("qid", "source", "node", (F.col("place") - 1).cast("long").alias("rank"), "score")


def diffusion_scope(adjacent: DataFrame, sources: DataFrame, degree: DataFrame, text: Column, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """The graph that walks of an entity-chunk graph run on: without text nodes but those that are anchors; and the anchors
    in it, or the entities of the highest degree for questions without one.

    text: whether a ``node`` is a text unit.
    """
    keep = adjacent.select("qid", F.col("src").alias("node")).distinct().join(sources.select("qid", F.col("source").alias("node"), F.lit(True).alias("anchor")).distinct(), ["qid", "node"], "left")
    keep = keep.filter(~text | F.coalesce("anchor", F.lit(False)))
    edges = reduced_edges(adjacent, keep)
    inside = edges.select("qid", F.col("src").alias("source")).distinct()
    named = sources.select("qid", "source").distinct().join(inside, ["qid", "source"], "left_semi")
    bare = inside.select("qid").distinct().join(named.select("qid").distinct(), "qid", "left_anti")
    inner = edges.groupBy("qid", F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("d")).join(bare, "qid", "left_semi")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("d"), "source"))
    top = inner.withColumn("r", rank).filter(F.col("r") <= most).select("qid", "source")
    return edges, named.union(top)
