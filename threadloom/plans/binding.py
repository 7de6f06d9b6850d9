"""The retrieval stages bound to tables: each property is one stage's DataFrame, built on the ones before it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import config
from ..functions import text as T
from ..operators import anchors as A
from ..operators import corridors as C
from ..operators import diffusion as D
from ..operators import graph as G
from ..operators import seeds as S
from ..operators import slabs as L
from ..operators.sizes import small

#: What the registered queries run with, and their SQL: distance, walk steps, perturbed graphs, candidates, seeds.
TAU, STEPS, RUNS, CANDIDATES, SEEDS = 4, 40, 3, 20, 4


@dataclass(frozen=True)
class Limits:
    """Numbers that the stages work with.

    tolerance: walks also end once a step changes less than that a node, looked
    up now and then. stable: only the best of a question's runs goes on. trim:
    selected units that hold nothing together are dropped.
    """

    tau: int = TAU
    steps: int = STEPS
    tolerance: float | None = None
    runs: int = RUNS
    candidates: int = CANDIDATES
    seeds: int = SEEDS
    anchors: int = 5
    documents: int = 5
    pairs: int = 6
    run_weights: Mapping[str, float] | None = None
    seed_bridge: float = 0.20
    seed_coverage: float = 0.10
    stable: bool = False
    trim: bool = False
    light_runs: int = 3
    full_runs: int = 2

    @classmethod
    def of(cls, values: Mapping[str, Any], stable: bool = False, trim: bool = False) -> Limits:
        """What settings stand for; walks go on to the tolerance."""
        weights = dict(config.objective(str(values["retrieval_objective_mode"]))["weights"])
        bridge, coverage = weights.pop("seed_bridge"), weights.pop("seed_coverage")
        number = lambda k: max(1, int(values[k]))
        return cls(
            tau=number("tau"), steps=100, tolerance=1e-6, runs=number("samples_per_anchor"), candidates=number("candidate_top_t"), seeds=number("seed_k"), anchors=number("max_anchors"),
            pairs=number("pair_shortlist_topb"), run_weights=weights, seed_bridge=bridge, seed_coverage=coverage, stable=stable, trim=trim,
            light_runs=number("phase1_run_preshortlist_topm"), full_runs=number("phase1_full_run_score_topk"),
        )


#: Tables of texts, where work a row is large.
TEXTS = ("documents", "conversations")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of texts in fewer files than there are cores is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in TEXTS and df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame) -> tuple:
    """Names, sizes and times of a table's files, as Spark's reader sees them: another write is another table."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    count, digest = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    return count, str(digest)


#: Bound tables of this process by session, folder and the state of its files: later queries go on from the stages that earlier ones have cut.
_KNOWN: dict[tuple, Retrieval] = {}
_MOST = 2


def forget() -> None:
    """Drop what is kept, so the next query starts from its tables."""
    _KNOWN.clear()


class Retrieval:
    """All questions at once: anchors, context graphs, diffusion, seeds, corridors and selected units.

    questions: qid, text; docs: doc_id, text; shaping: settings of the corridors' shaping terms. Stages that several others read
    are cut with a checkpoint, so a plan stays small and a lost executor costs
    little.
    """

    def __init__(self, questions: DataFrame, docs: DataFrame, shaping: dict | None = None, limits: Limits = Limits()):
        self.questions, self.docs, self.shaping, self.limits = questions, docs, shaping, limits

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Retrieval:
        key = (spark._jsparkSession.sessionUUID(), sf_dir, *(written(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in ("benchmark", "documents")))
        if key not in _KNOWN:
            while len(_KNOWN) >= _MOST:
                _KNOWN.pop(next(iter(_KNOWN)))
            questions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
            _KNOWN[key] = cls(questions, read(spark, sf_dir, "documents").select("doc_id", "text"))
        return _KNOWN[key]

    @cached_property
    def tokens(self) -> DataFrame:
        return A.document_tokens(self.docs)

    @cached_property
    def support(self) -> DataFrame:
        return A.token_support(self.tokens)

    @cached_property
    def anchors(self) -> DataFrame:
        # counts of the questions' tokens alone: the others never leave their task
        asked = small(A.question_tokens(self.questions).select("token").distinct())
        return D.cut(A.lexical_anchors(self.questions, A.token_support(self.tokens.join(asked, "token", "left_semi")), self.limits.anchors))

    @cached_property
    def hits(self) -> DataFrame:
        return D.cut(A.proposals(self.anchors, self.tokens, self.limits.documents))

    @cached_property
    def contexts(self) -> DataFrame:
        return D.cut(self.docs.join(small(self.hits.select("qid", "doc_id", F.col("rank").alias("doc_rank"))), "doc_id").select("doc_id", "qid", "doc_rank", "text"))

    @cached_property
    def edges(self) -> DataFrame:
        return D.cut(G.question_graph(self.contexts))

    @cached_property
    def adjacent(self) -> DataFrame:
        return D.cut(G.both_ways(self.edges, ("qid",)))

    @cached_property
    def degree(self) -> DataFrame:
        return G.degrees(self.adjacent, ("qid",))

    @cached_property
    def sources(self) -> DataFrame:
        named = self.anchors.select("qid", G.entity_node(F.col("token")).alias("source"))
        return named.join(self.adjacent.select("qid", F.col("src").alias("source")).distinct(), ["qid", "source"], "left_semi")

    @cached_property
    def distances(self) -> DataFrame:
        return D.cut(D.graph_distances(self.edges, self.sources, self.limits.tau))

    @cached_property
    def run_edges(self) -> DataFrame:
        """Perturbed graphs of each question: qid, run, src, dst."""
        return D.drop_edges(self.edges.select("qid", "src", "dst").distinct(), self.limits.runs)

    @cached_property
    def mass(self) -> DataFrame:
        """PageRank of every question and run: qid, run, node, mass."""
        start = D.restart_vector(self.sources.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(self.limits.runs - 1)))))
        ranked = D.graph_page_rank(D.cut(self.run_edges), start, self.limits.steps, tolerance=self.limits.tolerance)
        return D.cut(ranked.select("qid", F.col("run").cast("int").alias("run"), "node", "mass"))

    @cached_property
    def corpus_slabs(self) -> DataFrame:
        """The corpus graph packed for walks: chunks with the entities that they name."""
        return D.cut(L.slabs(G.linked_units(self.docs)))

    @cached_property
    def corpus_sources(self) -> DataFrame:
        """Even mass on each question's anchors as entities of the whole corpus: qid, node, mass."""
        named = self.anchors.select("qid", G.entity_node(F.col("token")).alias("node")).distinct()
        held = L.linked_nodes(self.corpus_slabs).join(small(named.select("node").distinct()), "node", "left_semi").distinct()
        return named.join(held, "node", "left_semi").withColumn("mass", 1 / F.count(F.lit(1)).over(Window.partitionBy("qid")))

    def corpus_mass(self, most: int, digits: int) -> DataFrame:
        """PageRank of every question over the corpus graph, whose edges join chunks and entities: qid, node, mass of the ``most`` heaviest and what ties with them."""
        return L.walk(self.corpus_slabs, self.corpus_sources, most, digits)

    @cached_property
    def sentences(self) -> DataFrame:
        """Text units of the contexts: qid, node, doc_id, unit_idx, text."""
        units = G.sentence_table(self.contexts, ("qid", "doc_id", "doc_rank"))
        return D.cut(units.withColumn("node", G.sentence_node(F.col("doc_id"), F.col("unit_idx"))))

    @cached_property
    def similarity(self) -> DataFrame:
        """Similarity of question and unit in -1..1, from shared content tokens; an encoder's vectors may stand in."""
        asked = self.questions.select("qid", F.array_distinct(T.content_tokens(F.col("text"))).alias("asked"))
        joined = self.sentences.join(asked, "qid")
        share = T.jaccard(F.col("asked"), F.array_distinct(T.content_tokens(F.col("text"))))
        return D.cut(joined.select("qid", "node", T.rounded(2 * share - 1, 9).alias("sim")))

    @cached_property
    def unit_tokens(self) -> DataFrame:
        return D.cut(self.sentences.select("qid", "node", F.array_distinct(T.content_tokens(F.col("text"))).alias("tokens")))

    @cached_property
    def anchor_similarity(self) -> DataFrame:
        """Similarity of a unit and the question's anchors in -1..1."""
        named = self.anchors.groupBy("qid").agg(F.collect_set("token").alias("named"))
        return self.unit_tokens.join(named, "qid").select("qid", "node", T.rounded(2 * T.jaccard(F.col("named"), F.col("tokens")) - 1, 9).alias("near_anchors"))

    @cached_property
    def mentions(self) -> DataFrame:
        """Units of each entity and entities of each unit: qid, node, linked, rank (from 0)."""
        pairs = self.edges.filter("edge_type = 'mentions'").select("qid", F.col("src").alias("unit"), F.col("dst").alias("entity"))

        def listed(key: str, value: str) -> DataFrame:
            place = F.row_number().over(Window.partitionBy("qid", key).orderBy(value))
            return pairs.select("qid", F.col(key).alias("node"), F.col(value).alias("linked"), (place - 1).cast("long").alias("rank"))

        return listed("entity", "unit").union(listed("unit", "entity"))

    @cached_property
    def grounding(self) -> DataFrame:
        """Of each entity: how well its first units fit the question."""
        links = self.mentions.filter(F.col("node").startswith("e::")).withColumnRenamed("linked", "unit")
        return S.grounding_bonus(links, self.similarity).select("qid", "node", T.rounded(F.col("ground"), 9).alias("ground"))

    @cached_property
    def candidates(self) -> DataFrame:
        return D.top_nodes(self.mass.withColumn("mass", T.settled(F.col("mass"), 9)), self.limits.candidates)

    @cached_property
    def components(self) -> DataFrame:
        """Seed components of the candidates: graph, semantic, anchor, bridge, ground, coverage."""
        near = self.distances.groupBy("qid", "node").agg(F.min("dist").alias("near"))
        joined = self.candidates
        for part in (self.similarity, self.anchor_similarity, S.bridge_bonus(self.distances, self.limits.tau), self.grounding, near):
            joined = joined.join(part, ["qid", "node"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        return joined.select("qid", "run", "node", "rank", F.col("mass").alias("graph"), zero("sim").alias("semantic"), zero("near_anchors").alias("anchor"), zero("bridge").alias("bridge"), zero("ground").alias("ground"), F.when(F.col("near") <= 1, 1.0).otherwise(0.0).alias("coverage"))

    @cached_property
    def seed_scores(self) -> DataFrame:
        return D.cut(S.objective_weights(S.seed_scores(self.components), self.limits.seed_bridge, self.limits.seed_coverage))

    @cached_property
    def seed_distances(self) -> DataFrame:
        """Distances between the candidates of one run (some dozen), up to tau."""
        starts = self.candidates.select("qid", F.col("node").alias("source")).distinct()
        return D.cut(D.graph_distances(self.edges, starts, self.limits.tau, among=True))

    @cached_property
    def seeds(self) -> DataFrame:
        pairs = self.seed_distances.join(self.candidates.select("qid", "run", "node"), ["qid", "node"]).select("qid", "run", F.col("source").alias("other"), "node", "dist")
        picked = S.greedy_seeds(self.seed_scores.select("qid", "run", "rank", "node", "weight"), pairs, self.limits.seeds, self.limits.tau)
        return D.cut(picked.join(self.seed_scores, ["qid", "run", "node"]))

    @cached_property
    def pairs(self) -> DataFrame:
        # alignment of a seed with an anchor: nearness, since all anchors walk together
        seeds = self.seeds.join(self.chosen, ["qid", "run"], "left_semi") if self.limits.stable else self.seeds
        align = self.distances.join(seeds.select("qid", "run", "node"), ["qid", "node"]).select("qid", "run", "source", "node", (1 / (1 + F.col("dist"))).alias("score"))
        return D.cut(C.pair_shortlist(seeds, self.sources, self.distances, align, self.similarity, self.limits.tau, self.limits.pairs))

    @cached_property
    def paths(self) -> DataFrame:
        return D.cut(C.shortest_paths(self.pairs, self.adjacent, self.distances, self.limits.tau))

    @cached_property
    def units(self) -> DataFrame:
        return D.cut(C.payloads(self.paths, self.adjacent))

    @cached_property
    def refined(self) -> DataFrame:
        """Local refinement of the pairs: qid, corridor, place, node, score."""
        hops = self.limits.tau + 1
        ends = self.pairs.select("qid", F.col("source")).distinct(), self.pairs.select("qid", F.col("seed").alias("source")).distinct()
        near, far = (D.cut(D.graph_distances(self.edges, e, hops)) for e in ends)
        nodes = C.local_nodes(self.pairs, near, far, self.paths, self.similarity)
        return D.cut(C.refine(D.cut(nodes), self.adjacent, self.pairs, self.mass, hops))

    @cached_property
    def runs(self) -> DataFrame:
        """Scores of each question's runs and what they are made of."""
        cover = S.pair_coverage(self.seeds, self.distances, self.limits.tau)
        spread = S.dispersion(self.seeds, self.seed_distances, self.limits.tau)
        bridge = S.bridge_utility(self.candidates, self.distances, self.limits.tau)
        weights = S.surrogate_weights(self.mass, self.limits.runs)
        starts = self.seeds.select("qid", "run", F.col("node").alias("source"))
        near = self.seed_distances.join(starts, ["qid", "source"]).groupBy("qid", "run", "node").agg(F.min("dist").alias("dist"))
        sim = self.seeds.groupBy("qid", "run").agg(F.max(0.5 * (F.col("semantic") + 1)).alias("semantic"))
        full = cover.join(S.connectivity(weights, near, spread, self.limits.tau), ["qid", "run"])
        for part in (bridge, sim, S.semantic_redundancy(self.seeds, self.unit_tokens), spread):
            full = full.join(part, ["qid", "run"])
        named = full.select("qid", "run", "semantic", F.col("coverage").alias("anchor"), F.col("connectivity").alias("structure"), F.col("utility").alias("bridge"), "redundancy", "dispersion")
        weights = self.limits.run_weights
        if weights is None:
            return D.cut(S.run_score(named))
        # what only some weight profiles look at
        more = S.bridge_completeness(self.seeds, self.distances, self.limits.tau).join(self.seeds.groupBy("qid", "run").agg(F.avg("ground").alias("grounding")), ["qid", "run"])
        return D.cut(S.run_score(named.join(more, ["qid", "run"]).withColumn("pair_coverage", F.col("anchor")), dict(weights)))

    @cached_property
    def chosen(self) -> DataFrame:
        """The run that each question goes on with: a light score first, the full one for its head, the best of these."""
        c = self.candidates.withColumnRenamed("mass", "score").join(self.similarity, ["qid", "node"], "left").fillna(0.0, ["sim"])
        light = S.shortlist_runs(S.precheck(c, self.seeds, self.distances, self.limits.tau), "pre_score", min(self.limits.light_runs, self.limits.full_runs)).select("qid", "run")
        return D.cut(S.shortlist_runs(self.runs.join(light, ["qid", "run"], "left_semi"), "run_score", 1).select("qid", "run"))

    @cached_property
    def trimmed(self) -> DataFrame:
        """Nodes of the corridors that hold their question's anchors and seeds together: qid, node."""
        ends = self.pairs.select("qid", F.col("source").alias("node"), F.lit(True).alias("anchor"), F.lit(False).alias("seed")).union(self.pairs.select("qid", F.col("seed").alias("node"), F.lit(False), F.lit(True)))
        on_path = self.paths.select("qid", F.explode("path").alias("node")).union(self.units.select("qid", "node"))
        nodes = on_path.select("qid", "node", F.lit(False).alias("anchor"), F.lit(False).alias("seed")).union(ends)
        nodes = D.cut(nodes.groupBy("qid", "node").agg(F.max("anchor").alias("anchor"), F.max("seed").alias("seed")))
        edges = A.reduced_edges(self.adjacent, nodes).filter("src < dst")
        return C.trim(nodes, edges)

    @cached_property
    def ranked(self) -> DataFrame:
        scored = C.corridor_scores(self.units, self.pairs, self.similarity, shaping=self.shaping)
        ends = self.pairs.select("qid", F.col("rank").alias("corridor"), F.array("source", "seed").alias("anchors"))
        return D.cut(scored.join(ends, ["qid", "corridor"]))

    @cached_property
    def selected(self) -> DataFrame:
        """Units of the corridors in order of score: qid, pos, node, text, score."""
        best = self.mass.groupBy("qid", "node").agg(F.max("mass").alias("mass"))
        units = self.units.select("qid", "node").distinct()
        if self.limits.trim:
            units = units.join(self.trimmed, ["qid", "node"], "left_semi")
        found = units.join(best, ["qid", "node"], "left").join(self.similarity, ["qid", "node"]).join(self.sentences.select("qid", "node", "text"), ["qid", "node"])
        score = T.settled(F.coalesce("mass", F.lit(0.0)) + 0.5 * (F.col("sim") + 1), 9)
        pos = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "node")).cast("long") - 1
        return D.cut(found.withColumn("score", score).withColumn("pos", pos).select("qid", "pos", "node", "text", "score"))

    @cached_property
    def features(self) -> DataFrame:
        return C.unit_features(self.selected, self.units, self.ranked, self.questions)

    @cached_property
    def gold(self) -> DataFrame:
        """Documents that contain a question's text.

        A document that contains the text has the text's inner tokens whole,
        so the rarest of them (by an equi-join) leaves few documents to test.
        Texts of fewer than three tokens have no inner one: the documents are
        scanned once for all of those, which are broadcast.
        """
        inner = self.questions.select("qid", "text", F.explode(F.array_distinct(F.slice(T.tokenize(F.col("text")), 2, F.greatest(F.lit(0), F.size(T.tokenize(F.col("text"))) - 2)))).alias("token"))
        held = self.docs.select("doc_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token"))
        freq = held.join(small(inner.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        rarest = inner.join(freq, "token").groupBy("qid").agg(F.min(F.struct("n", "token", "text")).alias("m")).select("qid", "m.token", F.col("m.text").alias("needle"))
        some = D.cut(held.join(small(rarest), "token").select("qid", "doc_id", "needle"))
        found = self.docs.join(small(some), "doc_id").filter(F.contains("text", "needle")).select("qid", "doc_id")
        short = self.questions.join(inner.select("qid").distinct(), "qid", "left_anti").select("qid", F.col("text").alias("needle"))
        if short.limit(1).count():
            found = found.union(self.docs.join(small(short), F.contains(F.col("text"), F.col("needle"))).select("qid", "doc_id"))
        return D.cut(found.select("qid", F.col("doc_id").cast("string").alias("unit_id"), "doc_id"))
