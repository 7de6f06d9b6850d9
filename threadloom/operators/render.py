"""Context rendering: flat and corridor packing under budgets, excerpts and packages, greedy diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def flat(selected: DataFrame, most: int = 10) -> DataFrame:
    """First ``most`` units of each question as numbered lines; whether the list was cut."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    lines = selected.withColumn("r", rank).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "node", "text")))).alias("l"), F.count(F.lit(1)).alias("n")
    )
    text = F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["r"].cast("string"), F.lit("] ("), x["node"], F.lit(") "), x["text"])), "\n")
    return lines.select("qid", text.alias("context"), F.size("l").cast("long").alias("units"), (F.col("n") > most).alias("truncated"))


#: Weight of connector-adjacent units, and of support units, in the flat order.
CONNECTOR, SUPPORT = 0.20, 0.20


def linear_score(f: DataFrame) -> Column:
    """base + .35 corridor + .45 main + .20 support + .20 connector + .12 overlap + .08 locality."""
    flag = lambda c: F.col(c).cast("double")
    return F.col("base") + 0.35 * F.col("best_score") + 0.45 * flag("is_main") + 0.20 * flag("is_support") + CONNECTOR * flag("is_connector") + 0.12 * F.col("overlap") + 0.08 * F.col("locality")


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def greedy(items: list[dict], most: int, weight: float, extra: Callable[[dict, list[dict]], float] = lambda x, chosen: 0.0) -> list[dict]:
    """Take the item of the best score - weight x largest Jaccard overlap with those taken + extra, again and again; first wins ties."""
    rest, taken = list(items), []
    while rest and len(taken) < most:
        value = [x["score"] - weight * max((_jaccard(x["tokens"], y["tokens"]) for y in taken), default=0.0) + extra(x, taken) for x in rest]
        k = max(range(len(rest)), key=lambda i: (value[i], -i))
        taken.append(rest.pop(k) | {"value": value[k]})
    return taken


def _per_question(rows: DataFrame, fields: list[str], order: str, work: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Sequential work on each question's short list, in one pass after a grouping by question."""
    grouped = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("items"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for qid, items in b[["qid", "items"]].itertuples(index=False):
                listed = [x if isinstance(x, dict) else x.asDict() for x in items]
                out += [(qid, *row) for row in work(listed)]
            yield pd.DataFrame(out, columns=names)

    return grouped.mapInPandas(run, schema)


def flat_role() -> Column:
    return T.role_of(F.col("overlap"), F.col("is_connector"), F.col("is_support"))


def mmr(features: DataFrame, most: int = 10, weight: float = 0.25, corridors: int | None = None) -> DataFrame:
    """Corridor-aware flat order: linear score, then greedy diversity.

    A pick loses ``weight`` x its largest overlap with those taken and .20 x
    ``weight`` for each one of its document; connector-adjacent units gain a
    quarter of their weight; a bridge loses .04 for each bridge beyond the
    answers, an answer .04 for each answer beyond the bridges and one.
    corridors: only units of the first so many, if there are any.
    """
    if corridors:
        inside = F.col("best_rank") <= corridors
        some = F.max(inside).over(Window.partitionBy("qid"))
        features = features.withColumn("__keep", inside | ~some).filter("__keep").drop("__keep")
    scored = features.withColumns({
        "score": T.rounded(linear_score(features) + 0.25 * CONNECTOR * F.col("is_connector").cast("double"), 9),
        "tokens": F.array_distinct(T.tokenize(F.col("text"))), "role": flat_role(), "title": F.regexp_extract("node", r"^[a-z]::(.*):\d+$", 1),
    })
    balance = (CONNECTOR + SUPPORT) / 10  # times .10 would be a hair above .04

    def work(items: list[dict]) -> list[tuple]:
        for x in items:
            x["tokens"] = set(x["tokens"])

        def extra(x: dict, taken: list[dict]) -> float:
            same = sum(y["title"] == x["title"] for y in taken)
            bridges, answers = (sum(y["role"] == r for y in taken) for r in ("bridge", "answer"))
            lopsided = {"bridge": max(0, bridges - answers), "answer": max(0, answers - bridges - 1)}.get(x["role"], 0)
            return -0.20 * weight * same - balance * lopsided

        return [(i + 1, x["node"], T.settled_number(x["value"])) for i, x in enumerate(greedy(items, most, weight, extra))]

    return _per_question(scored, ["node", "score", "tokens", "role", "title"], "pos", work, "qid long, place long, node string, value double")


def ordered(picked: DataFrame, features: DataFrame, strategy: str = "score") -> DataFrame:
    """Picked units (qid, node, value) in the order of a strategy: score, retrieval, corridor_rank or query_bridge_answer.

    Flags after a ``+`` switch the relation order on or off, as do the bare names.
    """
    base, *flags = [t.strip() for t in strategy.lower().split("+") if t.strip()] or ["score"]
    if base not in ("score", "retrieval", "corridor_rank", "query_bridge_answer", "qba"):
        flags, base = [*flags, base], "score"
    on, off = ({f"relation_{w}" for w in ws} for ws in (("on", "enabled", "ordering_on"), ("off", "disabled", "ordering_off")))
    base = "score" if off & set(flags) else "query_bridge_answer" if on & set(flags) else base
    rows = picked.join(features.select("qid", "node", "pos", "best_rank", flat_role().alias("role")), ["qid", "node"])
    role = F.when(F.col("role") == "query", 0).when(F.col("role") == "bridge", 1).otherwise(2)
    order = {"retrieval": ["pos"], "corridor_rank": ["best_rank", F.desc("value"), "pos"], "score": [F.desc("value"), "pos"]}.get(base, ["best_rank", role, F.desc("value"), "pos"])
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long")
    return rows.select("qid", place.alias("place"), "node", "role", "value")


def backfill_centers(units: DataFrame, ranked: DataFrame, base: DataFrame, corridors: int = 3, per_corridor: int = 1) -> DataFrame:
    """Centers of excerpts: of each of the first corridors the units that come first among those rendered (base: qid, node, place)."""
    best = ranked.filter(F.col("place") <= corridors).select("qid", "corridor", F.col("place").alias("corridor_place"))
    pool = units.select("qid", "corridor", "node", "role", "pos").join(best, ["qid", "corridor"]).join(base.select("qid", "node", "place"), ["qid", "node"], "left")
    once = pool.groupBy("qid", "corridor_place", "node").agg(F.min(F.struct(F.when(F.col("role") == "main", 0).otherwise(1).alias("r"), "pos")).alias("o"), F.min("place").alias("place"))
    w = Window.partitionBy("qid", "corridor_place").orderBy(F.col("place").asc_nulls_last(), "o", "node")
    kept = once.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_corridor)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("corridor_place", "k")).cast("long")
    parsed = kept.select("qid", rank.alias("rank"), F.regexp_extract("node", r"^[a-z]::(.*):\d+$", 1).alias("doc_id"), F.regexp_extract("node", r":(\d+)$", 1).cast("long").alias("unit_idx"))
    return parsed


def excerpt_units(packages: DataFrame, base: DataFrame, most: int = 4, dedup: bool = True) -> DataFrame:
    """Excerpt sentences in package order, without those rendered or taken before, cut at ``most``.

    packages: qid, rank, pos, node, text; base: qid, node. Adds ``candidates``,
    the sentences that could have been taken.
    """
    rows = packages.filter(F.trim("text") != "")
    if dedup:
        rows = rows.join(base.select("qid", "node").distinct(), ["qid", "node"], "left_anti")
        first = F.row_number().over(Window.partitionBy("qid", "node").orderBy("rank", "pos"))
        rows = rows.withColumn("__f", first).filter("__f = 1").drop("__f")
    w = Window.partitionBy("qid")
    placed = rows.withColumn("place", F.row_number().over(w.orderBy("rank", "pos", "node")).cast("long")).withColumn("candidates", F.count(F.lit(1)).over(w))
    return placed.filter(F.col("place") <= most).select("qid", "place", "rank", "node", "text", "candidates")


def grounded_context(base: DataFrame, excerpts: DataFrame, most: int = 12, extra: int = 4) -> DataFrame:
    """A context with a block of grounded excerpts behind it, within what the budget leaves.

    base: qid, context, units; excerpts: qid, place, text.
    """
    room = F.greatest(F.lit(0), F.least(F.lit(extra), F.lit(most) - F.col("units")))
    joined = excerpts.join(base.select("qid", "units"), "qid").filter(F.col("place") <= room)
    lines = joined.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("l"))
    block = F.concat(F.lit("[Grounded Chunk Excerpts]\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["text"])), "\n"))
    both = base.join(lines, "qid", "left")
    return both.select("qid", F.when(F.size("l") > 0, F.concat("context", F.lit("\n\n"), block)).otherwise(F.col("context")).alias("context"), (F.col("units") + F.coalesce(F.size("l"), F.lit(0))).cast("long").alias("units"), F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("excerpts"))


def corridor_context(units: DataFrame, ranked: DataFrame, texts: DataFrame, questions: DataFrame, corridors: int = 3, main: int = 3, support: int = 2, budget: int = 8) -> DataFrame:
    """Pack the best corridors under a budget of units: overflow drops low corridors, then support, then main units.

    Units rank by score + .35 overlap + .20 locality - .30 largest overlap with units placed before.
    """
    best = ranked.filter(F.col("place") <= corridors)
    ends = F.array_join("anchors", " ↔ ") if "anchors" in ranked.columns else F.lit("")
    rows = units.join(best.select("qid", "corridor", "place", "score", ends.alias("ends")), ["qid", "corridor"]).join(texts, ["qid", "node"]).join(questions.select("qid", F.col("text").alias("question")), "qid")
    rows = rows.select("qid", "place", "score", "ends", "role", "pos", "node", "text", "unit_score", T.tokenize(F.col("text")).alias("tokens"), T.tokenize(F.col("question")).alias("asked"))

    def work(items: list[dict]) -> list[tuple]:
        seen: dict[str, set] = {}
        blocks = []
        for place in sorted({x["place"] for x in items}):
            mine = [x for x in items if x["place"] == place]
            block = {"place": place, "score": mine[0]["score"], "ends": mine[0]["ends"], "main": [], "support": []}
            for role, most in (("main", main), ("support", support)):
                pool = [x for x in sorted((x for x in mine if x["role"] == role), key=lambda x: (x["pos"], x["node"])) if x["node"] not in seen]
                value = []
                for i, x in enumerate(pool):
                    tokens = set(x["tokens"])
                    value.append(x["unit_score"] + 0.35 * len(tokens & set(x["asked"])) + 0.20 / (i + 1) - 0.30 * max((_jaccard(tokens, y) for y in seen.values()), default=0.0))
                for i in sorted(range(len(pool)), key=lambda i: (-value[i], i))[:most]:
                    block[role].append(pool[i])
                    seen[pool[i]["node"]] = set(pool[i]["tokens"])
            blocks.append(block)
        count = lambda: sum(len(b["main"]) + len(b["support"]) for b in blocks)
        cut = count() > budget
        while count() > budget and len(blocks) > 1:
            blocks.pop()
        for role in ("support", "main"):
            for b in reversed(blocks):
                while count() > budget and b[role]:
                    b[role].pop()
        lines = []
        for b in blocks:
            lines.append(f"[Corridor {b['place']} | score={b['score']:.3f} | anchors={b['ends']}]")
            lines += [f"- {x['text']}" for x in b["main"]]
            if b["support"]:
                lines += ["Support:", *(f"- {x['text']}" for x in b["support"])]
        ids = [x["node"] for b in blocks for role in ("main", "support") for x in b[role]]
        return [("\n".join(lines), ",".join(ids), count(), cut)]

    return _per_question(rows, ["score", "ends", "role", "pos", "node", "text", "unit_score", "tokens", "asked"], "place", work, "qid long, context string, unit_ids string, units long, truncated boolean")


def bundles(units: DataFrame, ranked: DataFrame, features: DataFrame, strategy: str = "", corridors: int = 3, main: int = 3, support: int = 2) -> DataFrame:
    """Path bundles: of each of the best corridors its anchor, bridge and answer units, by score.

    Flags in ``strategy``: ``compact_lite`` caps corridors and units at two,
    ``dedup`` gives bridge and answer units to the first bundle only. Returns
    qid, bundle, role, place and node.
    """
    flags = set(strategy.lower().replace("+", " ").split())
    if "compact_lite" in flags:
        corridors, main, support = min(corridors, 2), min(main, 2), max(1, min(support, 2))
    best = ranked.filter(F.col("place") <= corridors).select("qid", "corridor", F.col("place").alias("bundle"))
    rows = units.join(best, ["qid", "corridor"]).join(features.select("qid", "node", (F.col("base") + 0.35 * F.col("overlap")).alias("value")), ["qid", "node"])
    once = rows.groupBy("qid", "bundle", "node", "role").agg(F.max("value").alias("value"), F.min("pos").alias("pos"))
    w = Window.partitionBy("qid", "bundle", "role").orderBy(F.desc(T.rounded(F.col("value"), 6)), "pos", "node")
    placed = once.withColumn("r", F.row_number().over(w))
    bridge = max(1, support // 2) if support else 0
    role = F.when(F.col("role") == "main", "anchor").when(F.col("r") <= bridge, "bridge").otherwise("answer")
    kept = placed.filter(((F.col("role") == "main") & (F.col("r") <= main)) | ((F.col("role") == "support") & (F.col("r") <= support)))
    kept = kept.select("qid", "bundle", role.alias("role"), F.col("r").alias("place"), "node")
    if "dedup" in flags:
        first = F.min(F.when(F.col("role") != "anchor", F.col("bundle"))).over(Window.partitionBy("qid", "node"))
        kept = kept.withColumn("first", first).filter((F.col("role") == "anchor") | (F.col("first") == F.col("bundle"))).drop("first")
    order = F.when(F.col("role") == "anchor", 0).when(F.col("role") == "bridge", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("qid", "bundle").orderBy(order, "place", "node")).cast("long")
    return kept.select("qid", "bundle", "role", place.alias("place"), "node")


def bundle_metrics(found: DataFrame) -> DataFrame:
    """Of each question: bundles, units a bundle, share with a bridge next to an answer, first complete bundle, share with an answer."""
    roles = found.groupBy("qid", "bundle").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("role") == "anchor").cast("int")).alias("a"), F.max((F.col("role") == "bridge").cast("int")).alias("b"), F.max((F.col("role") == "answer").cast("int")).alias("c"))
    whole = F.col("a") * F.col("b") * F.col("c")
    return roles.groupBy("qid").agg(
        F.count(F.lit(1)).alias("path_bundle_count"), F.round(F.avg("n"), 6).alias("avg_chunks_per_bundle"), F.round(F.avg(F.col("b") * F.col("c")), 6).alias("bridge_answer_adjacency_rate"),
        F.coalesce(F.min(F.when(whole == 1, F.col("bundle"))), F.lit(0)).cast("long").alias("first_complete_path_rank"), F.round(F.avg("c"), 6).alias("answer_path_coverage"),
    )


def excerpts(centers: DataFrame, sentences: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Sentences within a window around each center of the same document: an equi-join on the document, then a range test.

    centers: qid, rank, doc_id, unit_idx; sentences: doc_id, unit_idx, text.
    """
    c = centers.withColumnRenamed("unit_idx", "center")
    near = c.join(sentences, "doc_id").filter(F.col("unit_idx").between(F.col("center") - before, F.col("center") + after))
    listed = near.groupBy("qid", "rank", "doc_id", "center").agg(F.array_sort(F.collect_list(F.struct("unit_idx", "text"))).alias("l"))
    return listed.select("qid", "rank", "doc_id", "center", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("excerpt"))


def package_scores(packed: DataFrame, features: DataFrame, questions: DataFrame) -> DataFrame:
    """.50 / rank + .20 bridge + .15 support / 4 + .15 grounding + .05 / (corridor rank + 1) of each excerpt."""
    asked = questions.select("qid", F.array_distinct(T.tokenize(F.col("text"))).alias("asked"))
    joined = packed.join(features, ["qid", "rank"]).join(asked, "qid")
    ground = T.ratio(F.size(F.array_intersect("asked", T.tokenize(F.col("excerpt")))), F.size("asked"))
    corridor = F.when(F.col("best_rank") < 10**9, F.col("best_rank") + 1).otherwise(1000)
    score = 0.50 / F.col("rank") + 0.20 * F.col("bridge").cast("double") + 0.15 * F.col("support") / 4 + 0.15 * ground + 0.05 / corridor
    return joined.withColumn("score", T.rounded(score, 6))


def choose_packages(scored: DataFrame, most: int = 4, weight: float = 0.1) -> DataFrame:
    rows = scored.withColumn("tokens", F.array_distinct(T.tokenize(F.col("excerpt"))))

    def work(items: list[dict]) -> list[tuple]:
        for x in items:
            x["tokens"] = set(x["tokens"])
        return [(i + 1, x["rank"], T.settled_number(x["value"])) for i, x in enumerate(greedy(items, most, weight))]

    return _per_question(rows, ["score", "tokens"], "rank", work, "qid long, place long, rank long, value double")


def corridor_lift(units: DataFrame, questions: DataFrame, most: int = 2) -> DataFrame:
    """Best documents of a question by number of corridor units + .1 x title overlap, with the median unit as center."""
    parsed = units.withColumns({"doc_id": F.regexp_extract("node", r"^s::(.*):\d+$", 1), "idx": F.regexp_extract("node", r":(\d+)$", 1).cast("long")}).filter("doc_id != ''")
    by_doc = parsed.select("qid", "doc_id", "idx", "node").distinct().groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("idx")).alias("at"))
    asked = questions.select("qid", T.content_tokens(F.col("text")).alias("asked"))
    scored = by_doc.join(asked, "qid").withColumn("score", F.round(F.col("n") + 0.1 * F.size(F.array_intersect("asked", T.content_tokens(F.concat(F.lit("doc"), "doc_id")))), 6))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")).cast("long")
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most).select("qid", "rank", "doc_id", F.get("at", F.floor(F.size("at") / 2).cast("int")).alias("center"), "score")


def pin_support(items: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """Keep the first ``most``, but let support units replace the last others until ``least`` of them are in."""
    w = Window.partitionBy("qid").orderBy("pos", "node")
    flagged = items.withColumns({"r": F.row_number().over(w), "s": F.sum(F.col("is_support").cast("int")).over(w)})
    pinned = F.col("is_support") & (F.col("s") <= least)
    ordered = flagged.withColumn("r2", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(pinned), "r")))
    return ordered.filter(F.col("r2") <= most).withColumn("place", F.row_number().over(w).cast("long")).select("qid", "place", "node", "is_support")


def inject_gold(items: DataFrame, gold: DataFrame) -> DataFrame:
    """Diagnostic upper bound: gold units first, then the rest in order."""
    pool = gold.select("qid", "node", F.lit(0).alias("o"), F.lit(0).cast("long").alias("pos")).union(items.select("qid", "node", F.lit(1), F.col("pos").cast("long")))
    first = pool.groupBy("qid", "node").agg(F.min(F.struct("o", "pos")).alias("k"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("k.o", "k.pos", "node")).cast("long")
    return first.select("qid", rank.alias("place"), "node")


def heuristic_answer(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """The first context sentence with the most question tokens: qid, pos, text."""
    asked = questions.select("qid", F.array_distinct(T.tokenize(F.col("text"))).alias("asked"))
    scored = contexts.join(asked, "qid").withColumn("overlap", F.size(F.array_intersect("asked", T.tokenize(F.col("text")))).cast("long"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("overlap"), "pos"))
    return scored.withColumn("r", best).filter("r = 1").select("qid", "pos", "overlap", F.col("text").alias("answer"))


#: Weights of the head correction: sentences, and redundancy.
HEAD_WEIGHTS = {"base": 0.60, "best_score": 0.20, "is_main": 0.08, "is_support": 0.04, "overlap": 0.04, "locality": 0.04}


def correct_head(features: DataFrame, head: int = 3, redundancy: float = 0.04) -> DataFrame:
    """Re-order a question's first units by min-maxed features, one by one with a penalty for overlap; the rest stays.

    qid, pos, node and the features; returns qid, place, node.
    """
    top = features.filter(F.col("pos") < head)
    score = sum((w * (F.col(c).cast("double") if c.startswith("is_") else T.min_max_vector(F.col(c).cast("double"), "qid")) for c, w in HEAD_WEIGHTS.items()), F.lit(0.0))
    rows = top.withColumns({"score": T.rounded(score, 9), "tokens": F.array_distinct(T.content_tokens(F.col("text")))})

    def work(items: list[dict]) -> list[tuple]:
        for x in items:
            x["tokens"] = set(x["tokens"])
        return [(i + 1, x["node"]) for i, x in enumerate(greedy(items, len(items), redundancy))]

    first = _per_question(rows, ["score", "tokens", "node"], "pos", work, "qid long, place long, node string")
    return first.unionByName(features.filter(F.col("pos") >= head).select("qid", (F.col("pos") + 1).alias("place"), "node"))


def reorder_slice(features: DataFrame, head: int = 3) -> DataFrame:
    """Sort a question's first units by support, main, overlap, score and rank."""
    w = Window.partitionBy("qid", F.col("pos") >= head).orderBy(F.when(F.col("pos") >= head, F.col("pos")), F.desc("is_support"), F.desc("is_main"), F.desc("overlap"), F.desc("base"), "pos")
    inside = F.row_number().over(w).cast("long")
    return features.select("qid", F.when(F.col("pos") < head, inside).otherwise(F.col("pos") + 1).alias("place"), "node")


def clip_bundles(units: DataFrame, budget: int) -> DataFrame:
    """Keep the best unit of each role (anchor, bridge, answer) of a question, then fill the budget in order."""
    role = Window.partitionBy("qid", "role").orderBy("pos", "node")
    kept = units.withColumn("first", F.row_number().over(role) == 1)
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("first"), "pos", "node"))
    chosen = kept.withColumn("o", order).filter(F.col("o") <= budget)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "node")).cast("long")
    return chosen.select("qid", place.alias("place"), "role", "node")
