"""Experiment grids and reports over tables of run summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .quantiles import beside, quantiles
from .sizes import small


def grid(spark: SparkSession, axes: Mapping[str, Sequence], most: int | None = None) -> DataFrame:
    """All combinations of the axes, numbered in their order. More than ``most`` are an error."""
    size = 1
    for values in axes.values():
        size *= len(values)
    if most is not None and size > most:
        raise ValueError(f"{size} combinations; at most {most} are allowed")
    out = spark.range(1).select(F.lit(0).cast("long").alias("profile"))
    for name, values in axes.items():
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("__i", name)).withColumn("profile", F.col("profile") * len(values) + F.col("__i")).drop("__i")
    return out


def top_profiles(results: DataFrame, metric: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(metric), "profile")
    return results.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def feasible_best(results: DataFrame, flat: Mapping[str, float], corridor: Mapping[str, float]) -> DataFrame:
    """The best profile that keeps EM, gains F1 and is faster than the corridor baseline; else the best effort."""
    ok = (F.col("em") >= flat["em"]) & ((F.col("f1") >= corridor["f1"]) | (F.col("f1") > flat["f1"])) & (F.col("ms") < corridor["ms"])
    w = Window.orderBy(F.desc("feasible"), F.desc("f1"), F.desc("em"), "ms", "profile")  # one row per profile
    return results.withColumn("feasible", ok).withColumn("place", F.row_number().over(w).cast("long")).filter("place = 1")


def deltas(summaries: DataFrame, baseline: str, metrics: Sequence[str], dataset: str = "dataset", variant: str = "variant") -> DataFrame:
    """Every variant against its data set's baseline variant."""
    base = summaries.filter(F.col(variant) == baseline).select(dataset, *(F.col(m).alias(f"base_{m}") for m in metrics))
    joined = summaries.join(base, dataset, "left")
    return joined.select(dataset, variant, *metrics, *(F.round(F.col(m) - F.col(f"base_{m}"), 6).alias(f"delta_{m}") for m in metrics))


def guarded_top(variants: DataFrame, k: int, guard: float = -0.01, dataset: str = "dataset") -> DataFrame:
    """Best k of each data set by gains, among variants whose recall falls by no more than the guard; all if none does."""
    w = Window.partitionBy(dataset)
    safe = F.col("delta_recall") >= guard
    kept = variants.withColumn("any", F.max(safe).over(w)).filter(safe | ~F.col("any"))
    order = w.orderBy(F.desc("delta_f1"), F.desc("delta_em"), F.desc("delta_rendered"), "delta_ms", "variant")
    return kept.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k).drop("any")


def best_delta(variants: DataFrame, metric: str, dataset: str = "dataset") -> DataFrame:
    w = Window.partitionBy(dataset).orderBy(F.desc(metric), "variant")
    return variants.withColumn("o", F.row_number().over(w)).filter("o = 1").drop("o")


def pareto(variants: DataFrame, dataset: str = "dataset", baseline: str = "base") -> DataFrame:
    """Winners of each data set: accuracy, efficiency, and balance among those no worse and no slower than the baseline."""
    base = variants.filter(F.col("variant") == baseline).select(dataset, F.col("f1").alias("bf"), F.col("ms").alias("bm"))
    full = variants.join(base, dataset)
    ok = (F.col("f1") >= F.col("bf")) & (F.col("ms") <= F.col("bm"))
    gain = F.round(T.ratio(F.col("f1") - F.col("bf"), F.col("bf")) + T.ratio(F.col("bm") - F.col("ms"), F.col("bm")), 9)
    scored = full.withColumn("gain", F.when(ok, gain))
    w = Window.partitionBy(dataset)
    kinds = {"accuracy": w.orderBy(F.desc("f1"), "ms", "variant"), "efficiency": w.orderBy("ms", F.desc("f1"), "variant"), "balanced": w.orderBy(F.col("gain").desc_nulls_last(), "variant")}
    ranked = scored.withColumns({k: F.row_number().over(o) for k, o in kinds.items()})
    each = ranked.select(dataset, "variant", "f1", "ms", F.explode(F.filter(F.array(*(F.when(F.col(k) == 1, F.lit(k)) for k in kinds)), lambda x: x.isNotNull())).alias("winner"))
    return each.select(dataset, "winner", "variant", "f1", "ms")


def gap_to(summaries: DataFrame, reference: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long table of metrics against a reference system's constants: dataset, metric, ours, reference, gap."""
    ours = summaries.select("dataset", "variant", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "ours"))
    return ours.join(small(reference), ["dataset", "metric"]).select("dataset", "variant", "metric", "ours", "reference", F.round(F.col("ours") - F.col("reference"), 6).alias("gap"))


def cross_check(rows: DataFrame, left: str, right: str, by: Sequence[str]) -> DataFrame:
    """Means of two evaluators over the same predictions, and how they differ."""
    return rows.groupBy(*by).agg(
        F.round(F.avg(left), 6).alias("left_mean"), F.round(F.avg(right), 6).alias("right_mean"), F.round(F.avg(F.col(left) - F.col(right)), 6).alias("mean_diff"), F.round(F.max(F.abs(F.col(left) - F.col(right))), 6).alias("max_diff"), F.count(F.when(F.abs(F.col(left) - F.col(right)) > 1e-9, 1)).alias("n_diff")
    )


def backfill(summaries: DataFrame, computed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill missing fields from recomputed ones."""
    new = computed.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return summaries.join(new, list(keys), "left").select(*[c for c in summaries.columns if c not in columns], *(F.coalesce(c, f"__{c}").alias(c) for c in columns))


def length_audit(rows: DataFrame, text: str, by: Sequence[str], max_chars: int, max_tokens: int) -> DataFrame:
    """Lengths and clip rates: mean, exact percentiles, shares above the limits."""
    measured = rows.select(*by, F.length(text).alias("chars"), F.size(T.tokenize(F.col(text))).alias("tokens"))
    over = lambda c, most: F.round(F.avg(F.when(F.col(c) > most, 1.0).otherwise(0.0)), 6)
    told = measured.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("chars"), 4).alias("mean_chars"), F.max("chars").cast("long").alias("max_chars"), over("chars", max_chars).alias("char_clip_rate"), over("tokens", max_tokens).alias("token_clip_rate"))
    found = quantiles(measured, by, {"chars": {"p50_chars": 0.5, "p95_chars": 0.95, "p99_chars": 0.99}, "tokens": {"p95_tokens": 0.95}})
    q = [F.round(c, 4).alias(c) for c in ("p50_chars", "p95_chars", "p99_chars")]
    return beside(told, by, found, [*by, "n", "mean_chars", *q, "max_chars", "char_clip_rate", F.round("p95_tokens", 4).alias("p95_tokens"), "token_clip_rate"])


def weighted(parts: DataFrame, rates: Sequence[str], weight: str = "n") -> DataFrame:
    return parts.agg(F.sum(weight).alias("n"), *(F.round(F.sum(F.col(r) * F.col(weight)) / F.sum(weight), 6).alias(r) for r in rates))


def prompt_gate(prompts: DataFrame, text: str, most: int) -> DataFrame:
    """Token estimate of prompts (a quarter of the characters): percentiles, share above the limit, and whether none is."""
    size = prompts.select(F.ceil(F.length(text) / 4).alias("t"))
    over = F.avg(F.when(F.col("t") > most, 1.0).otherwise(0.0))
    told = size.agg(F.count(F.lit(1)).alias("n"), F.max("t").cast("long").alias("most"), F.round(over, 6).alias("over_rate"), (over == 0).alias("passed"))
    found = quantiles(size, (), {"t": {"p95": 0.95, "p99": 0.99}})
    return beside(told, (), found, ["n", F.round("p95", 4).alias("p95"), F.round("p99", 4).alias("p99"), "most", "over_rate", "passed"])


def pending_runs(planned: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned runs without a complete summary."""
    return planned.join(finished.filter("complete"), list(keys), "left_anti")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order: later lines of a result file win."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__r", rank).filter("__r = 1").drop("__r")


#: Stages of each category of work, by the case that it stands for.
CASES = {
    "A": ("phase1_ppr_ms", "phase1_run_scoring_ms"),
    "B": ("phase2_pair_shortlist_ms", "phase2_refine_ms"),
    "C": ("query_embed_ms", "semantic_lookup_entity_ms", "semantic_lookup_chunk_ms"),
    "D": ("proposal_union_ms", "proposal_subgraph_build_ms"),
    "E": ("sentence_rerank_ms", "render_ms"),
}


def recommendation(means: DataFrame) -> DataFrame:
    """Adds ``case``, the category with the largest mean time, and ``primary_stage``, the slowest stage; first wins ties.

    means: the stages' columns, retrieval_total_ms and proposal_subgraph_nodes.
    Where rendering leads, proposals go first if they take 15 % of retrieval
    and build 5,000 nodes or more.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sums = {case: sum((zero(c) for c in stages[1:]), zero(stages[0])) for case, stages in CASES.items()}
    stages = [c for group in CASES.values() for c in group]

    def first_of(values: dict[str, Column]) -> Column:
        top, out = F.greatest(*values.values()), F.lit(None).cast("string")
        for name, value in reversed(values.items()):
            out = F.when(value == top, name).otherwise(out)
        return out

    share = T.ratio(zero("proposal_subgraph_build_ms"), zero("retrieval_total_ms"))
    heavy = (share >= 0.15) & (zero("proposal_subgraph_nodes") >= 5000)
    case = first_of(sums)
    return means.withColumns({"case": F.when((case == "E") & heavy, "D").otherwise(case), "primary_stage": first_of({c: zero(c) for c in stages})})


def recomputed(predictions: DataFrame, golds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both sets of answer metrics over stored predictions: means by group, in the older and the newer definition.

    predictions: the group's columns, qid, prediction, golds; golds: qid, golds,
    which take the place of the stored ones where present.
    """
    from .metrics import score_answers

    joined = predictions.join(golds.select("qid", F.col("golds").alias("__new")), "qid", "left").withColumn("golds", F.coalesce("__new", "golds")).drop("__new")
    old = score_answers(joined, mode="legacy").withColumnsRenamed({"em": "em_legacy", "f1": "f1_legacy"})
    both = score_answers(old).withColumnsRenamed({"em": "em_parity", "f1": "f1_parity"})
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("em_legacy", "f1_legacy", "em_parity", "f1_parity")))
