"""Mixing sources to target weights by soft membership.

Two label columns span four domains. A naive-Bayes classifier of word
presence, fitted on a bounded sample of the labelled table and restricted to
words whose association with a label is significant, gives every document a
posterior for each domain. A domain whose target is zero takes from each
document by its own posterior alone: with a posterior u of such domains a
document is held to the share 1 - 2u, none from u = 1/2 on, and whole where u
is no more than ``leak``. So a document that is surely unwanted goes however
rare its kind is, and what posteriors leak into unwanted domains costs a clean
document twice its leak at most, whatever the leaks sum to. Projected gradient descent then fits nonnegative rates of what is
held, from one for each document, so that the expected tokens of each other
domain (tokens x posterior x rate, summed) come as near to the targets as least
squares can: a step moves each rate by the product of its posteriors and the
domains' weighted residuals, and cuts it at zero. All that a step needs from
the corpus is one distributed sum per domain. Native functions throughout.

Defined cases: a null text has no words and the prior's posterior; without
labelled documents posteriors are even and unwanted domains take nothing; labels that are null are left out; a
domain that no document belongs to cannot reach its target; repeated rows and
repeated ids count as often as they occur; an empty table gives no row; other
columns are ignored, or kept by ``keep_mixed``, which writes a row as often as
its rate says: the whole part of the rate, and once more for a share of rows,
drawn by hash of id, that is the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DOMAINS = ("good_clean", "poor_clean", "good_toxic", "poor_toxic")
P = [f"p_{d}" for d in DOMAINS]


@dataclass(frozen=True)
class Mix:
    """weights: target shares of all tokens; wanted: in their place, the domains to keep whole, all others go to zero."""

    weights: dict[str, float] = field(default_factory=lambda: {"good_clean": 0.95, "poor_clean": 0.05})
    wanted: tuple[str, ...] = ()
    #: posterior of unwanted domains that is taken for the classifier's noise
    leak: float = 0.05
    #: rows of the labelled table that the classifier is fitted on, at most about
    sample: int = 20_000
    buckets: int = 1 << 16
    #: least z-score of a word's association with a label
    z: float = 4.0
    steps: int = 40
    #: of each domain's own target
    tolerance: float = 1e-3

    def most(self) -> float | None:
        """The largest rate: one where domains are kept whole."""
        return 1.0 if self.wanted else None

    def unwanted(self) -> list[str]:
        """Posteriors of the domains whose target is zero."""
        return [p for p, x in zip(P, DOMAINS, strict=True) if (x not in self.wanted if self.wanted else not self.weights.get(x, 0.0))]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def bucket(word: Column, mix: Mix) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(mix.buckets)).cast("int")


def _association(label: str, n1: Column, n0: Column, z: float) -> Callable[[Column], Column]:
    """Of a bucket's counts: the log-odds its presence adds, those its absence adds, and whether it is used."""

    def of(r: Column) -> Column:
        c1, c0 = r[label].cast("double"), (r["n"] - r[label]).cast("double")
        p1, p0, p = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1), (c1 + c0 + 0.5) / (n1 + n0 + 1)
        score = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / (n1 + 0.5) + 1 / (n0 + 0.5)))
        absent = F.log((1 - p1) / (1 - p0))
        return F.struct(r["b"].alias("b"), (F.log(p1 / p0) - absent).alias("w"), absent.alias("a"), (F.abs(score) >= z).alias("use"))

    return of


def _score(label: str) -> Column:
    weights = F.col(f"__m.{label}.w")
    return F.aggregate("__hits", F.coalesce(F.col(f"__m.{label}.base"), F.lit(0.0)), lambda a, h: a + F.get(weights, h))


def classifier(docs: DataFrame, labels: DataFrame, mix: Mix) -> DataFrame:
    """One row ``m``: for each label the intercept and an array of weights per bucket.

    The sample is bounded by ``mix.sample`` (chosen by hash of id), so its
    join with the documents may broadcast it.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).filter("__id is not null and quality is not null and toxic is not null")
    share = known.agg((F.lit(float(mix.sample)) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("s")).scalar()
    drawn = F.shiftrightunsigned(F.xxhash64(F.col("__id"), F.lit("sample")), 11).cast("double") * F.lit(2.0**-53)
    sample = known.filter(drawn < share).groupBy("__id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    fitted = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    seen = fitted.select("quality", "toxic", F.array_distinct(F.transform(words(F.col("text")), lambda w: bucket(w, mix))).alias("f"))
    # bucket -1 counts the documents
    counted = seen.select("quality", "toxic", F.explode(F.concat(F.array(F.lit(-1)), "f")).alias("b"))
    by_bucket = counted.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
    rows = by_bucket.groupBy().agg(F.collect_list(F.struct("b", "n", "quality", "toxic")).alias("rows"))  # at most buckets + 1 entries
    total = rows.withColumn("all", F.get(F.filter("rows", lambda r: r["b"] == -1), F.lit(0)))
    made = []
    for label in ("quality", "toxic"):
        n1, n0 = F.col(f"all.{label}").cast("double"), (F.col("all.n") - F.col(f"all.{label}")).cast("double")

        stats = _association(label, n1, n0, mix.z)
        used = F.filter(F.transform(F.filter("rows", lambda r: r["b"] >= 0), stats), lambda s: s["use"])
        prior = F.coalesce(F.log((n1 + 0.5) / (n0 + 0.5)), F.lit(0.0))
        made.append(total.select(F.lit(label).alias("label"), prior.alias("prior"), used.alias("used")))
    flat = reduce(DataFrame.union, made)
    # scatter the used weights into dense arrays
    entries = flat.select("label", "prior", F.explode_outer("used").alias("u"))
    dense = entries.groupBy("label").agg(
        (F.first("prior") + F.coalesce(F.sum("u.a"), F.lit(0.0))).alias("base"),
        F.array_sort(F.collect_list(F.struct(F.col("u.b").alias("b"), F.col("u.w").cast("float").alias("w")))).alias("u"),
    )
    # sorted (bucket, weight) pairs become an array with one entry per bucket
    gaps = """transform(u, (x, i) -> concat(
        array_repeat(0F, x.b - if(i = 0, 0, u[i - 1].b + 1)), array(x.w)))"""
    array = F.expr(f"if(size(u) = 0 or u[0].b is null, array_repeat(0F, {mix.buckets}), concat(flatten({gaps}), array_repeat(0F, {mix.buckets} - 1 - element_at(u, -1).b)))")
    each = dense.select("label", F.struct("base", array.alias("w")).alias("s"))
    return each.groupBy().agg(*(F.max_by("s", F.when(F.col("label") == x, 1)).alias(x) for x in ("quality", "toxic"))).select(F.struct("quality", "toxic").alias("m"))


def posteriors(docs: DataFrame, model: Column, mix: Mix) -> DataFrame:
    """``docs`` with ``n_tokens`` and a posterior per domain. One projection, no shuffle."""
    named = docs.withColumn("__words", words(F.col("text"))).withColumn("__m", model)
    hit = lambda h: (F.get(F.col("__m.quality.w"), h) != 0) | (F.get(F.col("__m.toxic.w"), h) != 0)
    hits = F.array_distinct(F.filter(F.transform("__words", lambda w: bucket(w, mix)), hit))
    # a generator of one row keeps the optimizer from computing the hits again wherever they are used
    found = named.select(*docs.columns, F.size("__words").cast("long").alias("n_tokens"), "__m", F.explode(F.array(hits)).alias("__hits"))
    yes = {}
    for label in ("quality", "toxic"):
        score = _score(label)
        yes[label] = 1 / (1 + F.exp(-F.least(F.greatest(score, F.lit(-40.0)), F.lit(40.0))))
    found = found.withColumns({f"__{k}": v for k, v in yes.items()})
    good, toxic = F.col("__quality"), F.col("__toxic")
    shares = (good * (1 - toxic), (1 - good) * (1 - toxic), good * toxic, (1 - good) * toxic)
    return found.select(*docs.columns, "n_tokens", *(s.alias(p) for s, p in zip(shares, P, strict=True)))


def folded(start: Column, steps: list[list[float]], most: float | None = None) -> Column:
    """The rate that projected steps lead to: each holds every domain's weighted residual times the step size. Rates are cut at zero and, if given, at ``most``."""
    if not steps:
        return start
    held = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    # the posteriors are bound outside the fold, which would else compute them anew in every step
    inside = (lambda r: F.greatest(F.lit(0.0), r)) if most is None else (lambda r: F.least(F.lit(most), F.greatest(F.lit(0.0), r)))
    fold = lambda s: F.aggregate(held, s["start"], lambda r, g: inside(r - sum((s[p] * F.get(g, F.lit(i)) for i, p in enumerate(P)), F.lit(0.0))))
    return F.get(F.transform(F.array(F.struct(*P, start.alias("start"))), fold), F.lit(0))


def held(mix: Mix) -> Column:
    """The share of a document that domains with a target of zero leave of it."""
    # bound as in folded; four even posteriors tell nothing
    kept = lambda u: F.when(u <= mix.leak, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 * u))
    share = lambda s: F.when(reduce(lambda a, p: a & (s[p] == 0.25), P, F.lit(True)), 1.0).otherwise(kept(sum((s[p] for p in mix.unwanted()), F.lit(0.0))))
    return F.get(F.transform(F.array(F.struct(*P)), share), F.lit(0))


def fit_steps(table: DataFrame, mix: Mix) -> list[list[float]]:
    """Projected-gradient steps over a table of ``n_tokens`` and posteriors, until the residuals settle.

    Only domains with a target take part, over what the others leave (``held``);
    each one's residual counts against its own target, so a small one is not
    taken for settled. Where domains are to be kept whole (``mix.wanted``), these
    aim at all tokens that they have before the others are held back, the
    others at none, all residuals count alike in tokens, and no rate exceeds
    what ``held`` leaves of its document: no row is drawn twice.
    The driver holds one number per domain and step. A rate is a function of
    its document's posteriors and the steps so far, so no rate is stored
    between steps but once in eight, when the table is cut anew.
    """
    table = table.withColumns({"all_tokens": F.col("n_tokens"), "n_tokens": F.col("n_tokens") * held(mix)})
    d = range(len(P))
    gram = table.agg(F.sum("all_tokens").alias("all"), *(F.sum(F.col("n_tokens") * F.col(p)).alias(f"a{i}") for i, p in enumerate(P)), *(F.sum(F.col("all_tokens") * F.col(p)).alias(f"w{i}") for i, p in enumerate(P)), *(F.sum(F.col("n_tokens") * F.col(P[i]) * F.col(P[j])).alias(f"g{i}{j}") for i in d for j in d)).first()
    own = [gram[f"a{i}"] or 0.0 for i in d]
    everything = float(gram["all"] or 0)
    if not sum(own):
        return []
    if mix.wanted:
        target = [gram[f"w{i}"] if x in mix.wanted else 0.0 for i, x in enumerate(DOMAINS)]
        aims, scale, size = list(d), [1 / everything for _ in d], [everything for _ in d]
    else:
        weights = [mix.weights.get(x, 0.0) for x in DOMAINS]
        target = [w / sum(weights) * everything for w in weights]
        aims = [i for i in d if target[i]]
        # residuals count in units of what a unit of all rates would change
        scale, size = [1 / max(gram[f"g{i}{i}"], 1e-9 * everything) for i in d], target
    bound = max(sum(abs(gram[f"g{i}{j}"]) * (scale[i] * scale[j]) ** 0.5 for j in aims) for i in aims)
    steps: list[list[float]] = []
    now, since, done = own, table.withColumn("rate", F.lit(1.0)), 0
    for _ in range(mix.steps):
        if all(abs(now[i] - target[i]) <= mix.tolerance * size[i] for i in aims):
            break
        steps.append([scale[i] * (now[i] - target[i]) / bound if i in aims else 0.0 for i in d])
        rate = folded(F.col("rate"), steps[done:], mix.most())
        if len(steps) - done == 8:
            since, done = common.durable(since.withColumn("rate", rate)), len(steps)
            rate = F.col("rate")
        before, now = now, _totals(since.withColumn("r", rate))
        if all(abs(now[i] - before[i]) <= 0.01 * mix.tolerance * size[i] for i in aims):
            break
    return steps


def _totals(table: DataFrame) -> list[float]:
    return [x or 0.0 for x in table.agg(*(F.sum(F.col("n_tokens") * F.col(p) * F.col("r")) for p in P)).first()]


def mixed(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> tuple[Column, list[list[float]], DataFrame]:
    """The classifier, the steps, and the table of ids, tokens, posteriors and rates."""
    model = classifier(docs, labels, mix).scalar()
    table = common.durable(posteriors(docs.select("doc_id", "text"), model, mix).drop("text"))
    steps = fit_steps(table, mix)
    return model, steps, table.withColumn("rate", held(mix) * folded(F.lit(1.0), steps, mix.most()))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))[2]


def keep_mixed(docs: DataFrame, labels: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs``, whole, each as often as its rate says, so that expected totals are those of the fit."""
    model, steps, _ = mixed(docs, labels, mix)
    u = F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("mix")), 11).cast("double") * F.lit(2.0**-53)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), "doc_id", "text")
    scored = posteriors(rows, model, mix).withColumn("rate", held(mix) * folded(F.lit(1.0), steps, mix.most()))
    times = (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    drawn = scored.select("__row", times.alias("__times")).filter("__times > 0")
    if mix.most() is None:  # else no rate exceeds one
        drawn = drawn.withColumn("__times", F.explode(F.array_repeat(F.lit(0), F.col("__times"))))
    return drawn.select("__row.*")
