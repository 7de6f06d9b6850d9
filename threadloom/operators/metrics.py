"""Evaluation: answer scores, support-fact matching, recall, funnels, profiles and their aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .quantiles import beside, quantiles, tails

RECALL_KS = (1, 2, 5, 10, 20, 30, 50, 100, 150, 200)


def shared_tokens(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two token arrays: one fold over their sorted union, so linear after a sort."""
    sided = lambda tokens, side: F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(side).alias("s")))
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["t"].eqNullSafe(x["t"])
        return F.struct(
            x["t"].alias("t"),
            (F.when(same, acc["l"]).otherwise(0) + (1 - x["s"])).alias("l"),
            (F.when(same, acc["r"]).otherwise(0) + x["s"]).alias("r"),
            (acc["n"] + F.when(same, 0).otherwise(F.least(acc["l"], acc["r"]))).alias("n"),
        )

    merged = F.array_sort(F.concat(sided(left, 0), sided(right, 1)))
    return F.aggregate(merged, start, step, lambda acc: acc["n"] + F.least(acc["l"], acc["r"]))


def token_f1(prediction: Column, gold: Column, both_empty: float) -> Column:
    """Multiset overlap of answer tokens. ``both_empty``: 1 in the older definition, 0 in the newer one."""

    def score(s: Column) -> Column:
        p, g = s["p"], s["g"]
        value = lambda c: F.when(c > 0, 2.0 * c / (F.size(p) + F.size(g))).otherwise(0.0)  # noqa: E731  2PR/(P+R)
        none = (F.size(p) == 0) & (F.size(g) == 0)
        found = F.get(F.transform(F.array(shared_tokens(p, g)), value), F.lit(0))
        return F.when(none, both_empty).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(found)

    # bound by lambdas, so tokens are not made again for every count
    pair = F.struct(T.answer_tokens(prediction).alias("p"), T.answer_tokens(gold).alias("g"))
    return F.get(F.transform(F.array(pair), score), F.lit(0))


def exact_match(prediction: Column, gold: Column) -> Column:
    return (T.answer_key(prediction) == T.answer_key(gold)).cast("double")


def best_of(score: Column) -> Column:
    """The best score over an array of golds; 0 without golds."""
    return F.coalesce(F.array_max(score), F.lit(0.0))


def score_answers(rows: DataFrame, prediction: str = "prediction", golds: str = "golds", mode: str = "parity") -> DataFrame:
    """Adds ``em`` and ``f1``. ``parity`` takes the best of all golds, ``legacy`` the first gold."""
    p = F.col(prediction)
    if mode == "legacy":
        gold = F.coalesce(F.get(F.col(golds), F.lit(0)), F.lit(""))
        return rows.withColumns({"em": exact_match(p, gold), "f1": token_f1(p, gold, 1.0)})
    each = F.array_distinct(F.col(golds))
    return rows.withColumns({"em": best_of(F.transform(each, lambda g: exact_match(p, g))), "f1": best_of(F.transform(each, lambda g: token_f1(p, g, 0.0)))})


def support_matches(units: DataFrame, gold: DataFrame, title_fallback: bool = False) -> DataFrame:
    """Match predicted units to gold sentences of the same question and title.

    units: qid, rank, unit_id, text; gold: qid, unit_id, title, text. A
    sentence matches by id, a chunk if its text contains the gold sentence, a
    unit of no known form by its raw id. With ``title_fallback`` a chunk
    without text takes all gold sentences of its title. One row per unit, with
    the matched gold ids and the reasons. The joins are equi-joins on question
    and title, and on question and id; containment is tested within them.
    """
    parsed = units.withColumn("u", T.parse_unit(F.col("unit_id"))).select("qid", "rank", "unit_id", "text", "u.kind", "u.title")
    g = gold.select(F.col("qid").alias("g_qid"), F.col("unit_id").alias("gold_id"), F.col("title").alias("g_title"), F.col("text").alias("gold_text"))
    near = parsed.join(g, (parsed["qid"] == g["g_qid"]) & (parsed["title"] == g["g_title"]), "left")
    raw = gold.select("qid", "unit_id", F.lit(True).alias("raw")).distinct()
    near = near.join(raw, ["qid", "unit_id"], "left")
    has_text = F.coalesce(T.squash(F.col("text")), F.lit("")) != ""
    held = (T.match_key(F.col("gold_text")) != "") & F.contains(T.match_key(F.col("text")), T.match_key(F.col("gold_text")))
    chunk, fallback = F.col("kind") == "chunk", ~has_text & F.lit(title_fallback) & F.col("gold_id").isNotNull()
    hit = F.when(chunk, (has_text & held) | fallback).otherwise(F.col("unit_id") == F.col("gold_id"))
    grouped = near.withColumn("hit", F.coalesce(hit, F.lit(False))).groupBy("qid", "rank", "unit_id", "kind", "title").agg(
        F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("gold_id")))).alias("by_title"),
        F.count("gold_id").alias("same_title"),
        F.max(has_text).alias("has_text"),
        F.max(F.coalesce("raw", F.lit(False))).alias("raw"),
    )
    by_id = (F.col("kind") == "unknown") & F.col("raw")
    grouped = grouped.withColumn("matched", F.when(by_id, F.array("unit_id")).otherwise(F.col("by_title")))
    found, near_gold, sentence = F.size("matched") > 0, F.col("same_title") > 0, F.col("kind") == "sentence"
    reason = (
        F.when(sentence & found, "exact_sentence_id")
        .when(sentence & near_gold, "same_title_sentence_index_mismatch")
        .when(sentence, "sentence_title_not_in_gold")
        .when(chunk & ~near_gold, "chunk_title_not_in_gold")
        .when(chunk & ~F.col("has_text") & F.lit(title_fallback), "chunk_text_missing,chunk_title_fallback_no_text")
        .when(chunk & ~F.col("has_text"), "chunk_text_missing")
        .when(chunk & found, "chunk_contains_gold_sentence")
        .when(chunk, "chunk_text_no_gold_sentence_match")
        .when(F.col("raw"), "exact_sentence_id_raw")
        .otherwise("unrecognized_unit_id_format")
    )
    return grouped.select("qid", "rank", "unit_id", "kind", "title", "matched", reason.alias("reason"))


def support_debug(matches: DataFrame, gold: DataFrame) -> DataFrame:
    """Every gold sentence of a question, whether it was matched, and if not, why.

    matches: as ``support_matches`` gives them; gold: qid, unit_id, title.
    """
    hits = matches.select("qid", F.explode("matched").alias("unit_id")).distinct().withColumn("matched", F.lit(True))
    titles = matches.groupBy("qid", "title").agg(
        F.max(F.col("kind") == "sentence").alias("sentence"),
        F.max(F.col("reason").startswith("chunk_text_missing")).alias("bare"),
        F.max(F.col("kind") == "chunk").alias("chunk"),
    )
    joined = gold.select("qid", "unit_id", "title").distinct().join(hits, ["qid", "unit_id"], "left").join(titles, ["qid", "title"], "left")
    reason = (
        F.when(F.col("matched"), "matched")
        .when(F.col("sentence").isNull(), "no_predicted_unit_with_same_title")
        .when(F.col("sentence"), "same_title_sentence_present_but_gold_sentence_missing")
        .when(F.col("bare"), "same_title_chunk_text_missing")
        .when(F.col("chunk"), "same_title_chunk_without_gold_sentence_containment")
        .otherwise("unmatched")
    )
    return joined.select("qid", "unit_id", "title", F.coalesce("matched", F.lit(False)).alias("matched"), reason.alias("reason"))


def recall_table(matches: DataFrame, gold: DataFrame, ks: Sequence[int] = RECALL_KS) -> DataFrame:
    """Per question: recall, precision and recall at each k. Ranks are cut before repeats are dropped."""
    totals = gold.groupBy("qid").agg(F.count_distinct("unit_id").alias("n_gold"))
    hits = matches.select("qid", "rank", "unit_id", F.explode_outer("matched").alias("gold_id"))
    found = hits.groupBy("qid").agg(
        F.count_distinct("gold_id").alias("hit"),
        F.count_distinct(F.when(F.col("gold_id").isNotNull(), F.col("unit_id"))).alias("good"),
        F.count_distinct("unit_id").alias("units"),
        *(F.count_distinct(F.when(F.col("rank") <= k, F.col("gold_id"))).alias(f"hit_{k}") for k in ks),
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = totals.join(found, "qid", "left")
    return joined.select("qid", T.ratio(none("hit"), F.col("n_gold")).alias("recall"), T.ratio(none("good"), none("units")).alias("precision"), *(T.ratio(none(f"hit_{k}"), F.col("n_gold")).alias(f"recall_{k}") for k in ks))


def means(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Mean of each column, 0 for no values, and the number of rows."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(c) for c in columns))


def loss_funnel(stages: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """Share of gold units that each stage's candidates still hold, and the loss from the stage before."""
    parts = [df.select("qid", "unit_id").withColumn("stage", F.lit(name)).withColumn("pos", F.lit(i)) for i, (name, df) in enumerate(stages.items())]
    held = reduce(DataFrame.union, parts).distinct()
    names = gold.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], "pos int, stage string")
    want = gold.select("qid", "unit_id").distinct().join(F.broadcast(names))
    joined = want.join(held.withColumn("hit", F.lit(1)), ["qid", "unit_id", "stage", "pos"], "left")
    rate = joined.groupBy("pos", "stage").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("rate"))
    before = F.lag("rate").over(Window.orderBy("pos"))  # one row per stage
    return rate.select("stage", F.round("rate", 6).alias("rate"), F.round(F.coalesce(before - F.col("rate"), F.lit(0.0)), 6).alias("loss"))


def describe(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, median, 90th percentile (linear interpolation) and maximum."""
    told = rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("max"))
    found = quantiles(rows, by, {value: {"median": 0.5, "p90": 0.9}})
    return beside(told, by, found, [*by, "n", "mean", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), "max"])


def pearson(rows: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Correlation; null for fewer than two rows or no variance."""
    flat = (F.count(F.lit(1)) < 2) | (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
    return rows.groupBy(*by).agg(F.round(F.when(~flat, F.corr(x, y)), 6).alias("pearson"))


def fast_slow(rows: DataFrame, value: str, by: Sequence[str], share: float = 0.3) -> DataFrame:
    """Means of the fastest and slowest share of each group (at least one row each); rows without a value take no part."""
    return tails(rows, value, by, share).select(*by, F.round("low", 6).alias("fast_mean"), F.round("high", 6).alias("slow_mean"))


def bottlenecks(rows: DataFrame, stage: str, value: str) -> DataFrame:
    """Stages by their share of the total time."""
    per = rows.groupBy(stage).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))
    every = per.agg(F.sum("total")).scalar()
    w = Window.orderBy(F.desc("total"), stage)  # one row per stage
    return per.select(F.row_number().over(w).cast("long").alias("place"), stage, F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round(T.ratio(F.col("total"), every), 6).alias("share"))


def evidence_flags(rows: DataFrame) -> DataFrame:
    """Adds what a question's evidence had: ``bridge``, ``answer``, ``failed`` (generation) and ``noisy``.

    rows: run_bridge_coverage, seed_bridge_recall, rendered_recall,
    seed_answer_recall, answer_side_density, precision, rendered_precision,
    bridge_noise_ratio, redundancy_rate, f1, qa_executed.
    """
    bridge = F.greatest("run_bridge_coverage", "seed_bridge_recall") >= 0.35
    answer = F.greatest("rendered_recall", "seed_answer_recall", "answer_side_density") >= 0.25
    loose = (F.greatest("precision", "rendered_precision") < 0.25) & ((F.col("redundancy_rate") >= 0.60) | (F.col("f1") < 0.25))
    noise = F.least(F.greatest(F.col("bridge_noise_ratio"), F.lit(0.0)), F.lit(1.0)) >= 0.55
    return rows.withColumns({"bridge": bridge, "answer": answer, "failed": F.col("qa_executed") & (F.col("f1") <= 0.01), "noisy": bridge & answer & (noise | loose)})


def error_bucket(bridge: Column, answer: Column, failed: Column, noisy: Column) -> Column:
    """The first thing that went wrong with a question, or ``none``."""
    return F.when(~bridge, "bridge_missing").when(~answer, "answer_side_missing").when(failed, "answer_present_generation_fail").when(noisy, "bridge_present_noisy").otherwise("none")


def derived(rows: DataFrame) -> DataFrame:
    """Retention, conversion and efficiency figures of run summaries.

    rows: recall, rendered, f1, recall_at_5, retrieval_ms, total_ms, ceiling
    and reference_f1, reference_r5; a figure without its ceiling, reference or
    time is 0.
    """
    none = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    over = lambda a, c: F.round(F.when(none(c) > 0, a / none(c)).otherwise(0.0), 6)
    gap = F.when(none("ceiling") > 0, none("ceiling") - none("f1")).otherwise(0.0)
    behind = lambda ref, c: F.round(F.when(none(ref) > 0, none(ref) - none(c)).otherwise(0.0), 6)
    return rows.withColumns({
        "retention": over(none("rendered"), "recall"),
        "conversion": over(none("f1"), "rendered"),
        "oracle_gap": F.round(gap, 6),
        "f1_per_100ms": over(100 * none("f1"), "total_ms"),
        "r5_per_100ms": over(100 * none("recall_at_5"), "retrieval_ms"),
        "oracle_gap_per_ms": over(gap, "total_ms"),
        "gap_to_reference_f1": behind("reference_f1", "f1"),
        "gap_to_reference_r5": behind("reference_r5", "recall_at_5"),
    })


#: Components of a corridor that count by 1 / place in a question's averages; what stands for one that is missing.
CORRIDOR_RATES = {
    "bridge_purity": "bridge", "answer_side_density": "answer", "support_set_compactness": None, "bridge_noise_ratio": None, "answer_preserve_activation_rate": None,
    "preserved_answer_usefulness": None, "path_complete_rate": None, "bridge_answer_pair_retention": None, "incomplete_path_rate": None, "chain_compactness": None,
    "path_preserve_activation_rate": None,
}


def connector_metrics(corridors: DataFrame, runs: DataFrame) -> DataFrame:
    """Rates of a question's evidence chain, from its corridors and its chosen run.

    corridors: qid, place, anchor, bridge, answer (scores), span (support
    units), and any of ``CORRIDOR_RATES``; runs: qid, seed_anchor_recall,
    seed_bridge_recall, seed_answer_recall, seed_diversity, seed_redundancy,
    run_bridge_coverage, redundancy_rate. Averages weigh a corridor by 1 / place.
    """
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    have = set(corridors.columns)
    compact = 1.0 / (1 + F.greatest(F.lit(0), F.col("span") - 1))
    stand = {"bridge_purity": F.col("bridge"), "answer_side_density": F.col("answer"), "support_set_compactness": compact, "bridge_noise_ratio": 1 - F.col("bridge"), "chain_compactness": compact}
    parts = corridors.withColumns({c: unit(F.coalesce(F.col(c), stand.get(c, F.lit(0.0))) if c in have else stand.get(c, F.lit(0.0))) for c in CORRIDOR_RATES})
    total = F.greatest(F.lit(1e-8), F.col("anchor") + F.col("bridge") + F.col("answer"))
    parts = parts.withColumns({"w": 1.0 / F.col("place"), **{f"{c}_role_share": F.col(c) / total for c in ("anchor", "bridge", "answer")}})
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    top = lambda c: F.max(unit(F.col(c)))
    shares = [f"{c}_role_share" for c in ("anchor", "bridge", "answer")]
    per = parts.groupBy("qid").agg(*(mean(c).alias(c) for c in (*CORRIDOR_RATES, *shares)), *(top(c).alias(f"max_{c}") for c in ("anchor", "bridge", "answer")))
    joined = runs.join(per, "qid", "left")
    zero = {c: 0.0 for c in (*CORRIDOR_RATES, "max_anchor", "max_bridge", "max_answer")} | {c: 1 / 3 for c in shares} | {"support_set_compactness": 1.0, "chain_compactness": 1.0, "bridge_noise_ratio": 1.0}
    joined = joined.fillna(zero).withColumn("corridor_role_coverage", (F.col("max_anchor") + F.col("max_bridge") + F.col("max_answer")) / 3)
    bridge = F.col("run_bridge_coverage") >= 0.35
    answer = (F.col("max_answer") >= 0.35) | (F.col("answer_side_density") >= 0.35)
    flag = lambda c: c.cast("double")
    both = bridge & answer
    quality = [F.col(c) for c in ("seed_bridge_recall", "run_bridge_coverage", "corridor_role_coverage", "path_complete_rate", "bridge_purity", "chain_compactness")]
    made = joined.withColumns({
        "anchor_bridge_balance": unit(1 - (F.greatest(*shares) - F.least(*shares))),
        "useful_bridge_rate": flag(both & (F.col("bridge_purity") >= 0.40)),
        "bridge_to_answer_path_hit": flag(both & (F.col("corridor_role_coverage") >= 0.45) & (F.col("bridge_purity") >= 0.35)),
        "conversion_after_bridge_proxy": flag(both & (F.col("answer_side_density") >= 0.35) & (F.col("bridge_purity") >= 0.35)),
        "conversion_after_preserve_proxy": flag(both & (F.col("answer_preserve_activation_rate") >= 0.5) & (F.col("preserved_answer_usefulness") >= 0.35)),
        "conversion_after_path_preserve_proxy": flag(both & (F.col("path_preserve_activation_rate") >= 0.25) & (F.col("path_complete_rate") >= 0.45) & (F.col("incomplete_path_rate") <= 0.55)),
        "connector_quality": sum(quality[1:], quality[0]) / 6,
    })
    return made.select("qid", *(F.round(c, 6).alias(c) for c in made.columns if c != "qid" and not c.startswith("max_")))


def profile_records(timings: DataFrame, stages: Sequence[str], key: str = "qid", stage: str = "stage", ms: str = "ms") -> DataFrame:
    """One row per question: milliseconds of each stage (0 if it did not run), their sum, and how many stages ran."""
    kept = timings.filter(F.col(stage).isin(*stages))
    each = [F.round(F.coalesce(F.sum(F.when(F.col(stage) == s, F.col(ms))), F.lit(0.0)), 6).alias(f"{s}_ms") for s in stages]
    return kept.groupBy(key).agg(*each, F.round(F.sum(ms), 6).alias("total_ms"), F.count_distinct(stage).alias("n_stages"))


def profile_subset(rows: DataFrame, key: str, indices: Sequence[int] | None = None, limit: int | None = None) -> DataFrame:
    """The rows to profile, numbered by the key's order: those at the given places, then at most ``limit`` of them."""
    # a profile's table has one row per question
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(key)).cast("long") - 1)
    if indices is not None:
        placed = placed.filter(F.col("place").isin(*map(int, indices)))
    if limit is not None:
        placed = placed.withColumn("k", F.row_number().over(Window.orderBy("place"))).filter(F.col("k") <= limit).drop("k")
    return placed


def run_summary(rows: DataFrame, columns: Sequence[str], hit: Column, by: Sequence[str] = ()) -> DataFrame:
    """One wide aggregate: questions, the mean of every column (0 for none), and the share of rows with a hit."""
    share = F.round(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)), 6).alias("hit_rate")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share, *(F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6).alias(c) for c in columns))


def clipping_closed(rows: DataFrame, rates: Sequence[str], eps: float = 1e-9) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(r), F.lit(0.0)) <= eps for r in rates])


def histogram(rows: DataFrame, reason: str, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by)
    counted = rows.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))
