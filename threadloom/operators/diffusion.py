"""Distances and personalized PageRank over many question graphs at once."""

from __future__ import annotations

import itertools
import math
import tempfile
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .sizes import small

RESTART = 0.15


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a frame made by ``cut`` that nothing reads any more, and let Spark drop the shuffles behind it; other frames stay as they are."""
    sc = df.sparkSession.sparkContext
    plan = df._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        sc._jvm.System.gc()  # shuffle files of rounds that are over go with the driver's references to them


def distances(adjacent: DataFrame, sources: DataFrame, depth: int, every: int = 3, settle: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Breadth-first distances up to ``depth`` from every (qid, source).

    Each round joins the frontier with the edges and drops what was seen, so
    a node enters once; the lineage is cut every few rounds.
    """
    seen = sources.select("qid", "source", F.col("source").alias("node"), F.lit(0).alias("dist"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select("qid", "source", F.col("node").alias("src")).join(adjacent, ["qid", "src"]).select("qid", "source", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, ["qid", "source", "node"], "left_anti").withColumn("dist", F.lit(d))
        seen = seen.union(frontier)
        if d % every == 0 and d < depth:
            seen = settle(seen)
            frontier = seen.filter(F.col("dist") == d)
    return seen


def apart(edges: DataFrame, keys: tuple[str, ...], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of the graphs that have no more than ``most``, and those of larger ones (none: None)."""
    large = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*keys)
    if not large.limit(1).count():
        return edges, None
    large = cut(large)
    return edges.join(large, list(keys), "left_anti"), edges.join(large, list(keys), "left_semi")


def numbered(edges: pa.Table, ends: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A small graph's nodes, its edges both ways as places of these, sorted and once each, and the places of ``ends``."""
    named = pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks, *ends.chunks], type=ends.type).combine_chunks().dictionary_encode()
    at, n, m = named.indices.to_numpy().astype(np.int64), len(named.dictionary), edges.num_rows
    a, b = at[:m], at[m : 2 * m]
    code = np.unique(np.concatenate([a * n + b, b * n + a]))
    return named.dictionary, code // n, code % n, at[2 * m :]


def meet(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...], work: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """``work`` on each graph's edges and where it starts."""
    starts = starts.withColumnsRenamed({k: f"start_{k}" for k in keys})  # both sides may come from one table
    return edges.groupBy(*keys).cogroup(starts.groupBy(*(f"start_{k}" for k in keys))).applyInArrow(work, schema)


def graph_distances(edges: DataFrame, sources: DataFrame, depth: int, among: bool = False, most: int = 2_000_000) -> DataFrame:
    """``distances`` in many small graphs (qid, src, dst; undirected): each question's edges meet in one task and are searched there.

    among: only distances between sources. Graphs of more than ``most`` edges are searched by joins.
    """
    sources = sources.select("qid", "source").distinct()
    edges = edges.select("qid", "src", "dst").filter("src is not null and dst is not null")
    near, far = apart(edges, ("qid",), most)
    kind = sources.schema["qid"].dataType

    def work(key: tuple, links: pa.Table, starts: pa.Table) -> pa.Table:
        nodes, src, dst, at = numbered(links, starts["source"])
        rows = []
        for s in at:
            dist = np.full(len(nodes), -1, np.int32)
            dist[s] = 0
            for d in range(1, depth + 1):
                met = dst[(dist == d - 1)[src]]
                dist[met[dist[met] < 0]] = d
            found = at[dist[at] >= 0] if among else np.flatnonzero(dist >= 0)
            rows.append((np.full(len(found), s), found, dist[found]))
        source, node, dist = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        return pa.table({"qid": pa.repeat(key[0], len(node)), "source": nodes.take(pa.array(source)), "node": nodes.take(pa.array(node)), "dist": pa.array(dist, pa.int32())})

    schema = StructType([StructField("qid", kind), StructField("source", StringType()), StructField("node", StringType()), StructField("dist", IntegerType())])
    if far is None:
        return meet(near, sources, ("qid",), work, schema)
    large = cut(far.select("qid").distinct())
    found = meet(near, sources.join(large, "qid", "left_anti"), ("qid",), work, schema)
    wide = sources.join(large, "qid", "left_semi")
    rest = distances(cut(far.union(far.select("qid", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()), wide, depth)
    return found.union(rest.join(wide.withColumnRenamed("source", "node"), ["qid", "node"], "left_semi").select(*found.columns) if among else rest)


def capped(pairs: DataFrame, table: DataFrame, cap: int) -> DataFrame:
    """Distance of each (qid, source, node), ``cap`` where farther or unreachable."""
    return pairs.join(table, ["qid", "source", "node"], "left").withColumn("dist", F.least(F.lit(cap), F.coalesce("dist", F.lit(cap))))


def set_distance(table: DataFrame, nodes: DataFrame, cap: int) -> DataFrame:
    """Distance of each node to the nearest source of its question."""
    near = table.groupBy("qid", "node").agg(F.min("dist").alias("dist"))
    return nodes.join(near, ["qid", "node"], "left").withColumn("dist", F.least(F.lit(cap), F.coalesce("dist", F.lit(cap))))


def restart_vector(sources: DataFrame) -> DataFrame:
    """Even mass on the sources of each walker (qid, run)."""
    w = Window.partitionBy("qid", "run")
    return sources.select("qid", "run", F.col("source").alias("node")).distinct().withColumn("mass", 1 / F.count(F.lit(1)).over(w))


def page_rank(adjacent: DataFrame, restart: DataFrame, steps: int, alpha: float = RESTART, prune: float = 0.0, every: int = 4, settle: Callable[[DataFrame], DataFrame] = cut, tolerance: float | None = None) -> DataFrame:
    """Personalized PageRank of each (qid, run) by power iteration.

    Where ``adjacent`` has a column ``run``, each run walks on its own graph.
    Unweighted; the mass of nodes without edges goes back to the restart
    vector. By linearity a sum over sources is one walk from their joint
    vector, so runs with many sources cost no more than one. With
    ``tolerance`` each (qid, run) stops on its own, once a step changes its
    mass by less than that much a node of its graph; looked up every ``every``
    steps.
    """
    walkers = restart.select("qid", "run").distinct()
    if "run" not in adjacent.columns:
        adjacent = adjacent.join(walkers, "qid")
    at = ["qid", "run", "src"]
    degree = adjacent.groupBy(*at).agg(F.count(F.lit(1)).alias("deg"))
    size = degree.groupBy("qid", "run").agg(F.count(F.lit(1)).alias("n"))
    # a node without edges moves to the restart nodes: so a step is one join, and a plan of several steps stays a line
    ends = adjacent.select("qid", "run", F.col("dst").alias("src")).union(restart.select("qid", "run", F.col("node").alias("src"))).distinct().join(degree, at, "left_anti")
    back = ends.join(restart.select("qid", "run", F.col("node").alias("dst"), ((1 - alpha) * F.col("mass")).alias("share")), ["qid", "run"]).select(*at, "dst", "share")
    moves = settle(adjacent.join(degree, at).select(*at, "dst", ((1 - alpha) / F.col("deg")).alias("share")).union(back))
    rank, settled = restart, []
    for k in range(1, steps + 1):
        spread = rank.withColumnRenamed("node", "src").join(moves, at).select("qid", "run", F.col("dst").alias("node"), (F.col("mass") * F.col("share")).alias("mass"))
        again = restart.select("qid", "run", "node", (alpha * F.col("mass")).alias("mass"))
        new = spread.union(again).groupBy("qid", "run", "node").agg(F.sum("mass").alias("mass"))
        if prune:
            new = new.filter(F.col("mass") >= prune)
        if k % every == 0 and k < steps:
            new = settle(new)
            if tolerance is not None:
                both = new.withColumnRenamed("mass", "now").join(rank, ["qid", "run", "node"], "full_outer")
                gap = both.groupBy("qid", "run").agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("mass", F.lit(0.0)))).alias("gap"))
                gap = settle(gap.join(size, ["qid", "run"], "left").withColumn("still", F.col("gap") >= tolerance * F.coalesce("n", F.lit(1))))
                left, all_of_them = gap.agg(F.count_if("still"), F.count(F.lit(1))).first()
                if not left:
                    return reduce(DataFrame.union, [*settled, new])
                if left < all_of_them:
                    still = gap.filter("still").select("qid", "run")
                    settled.append(new.join(still, ["qid", "run"], "left_anti"))
                    new, restart = settle(new.join(still, ["qid", "run"], "left_semi")), settle(restart.join(still, ["qid", "run"], "left_semi"))
        rank = new
    return reduce(DataFrame.union, [*settled, rank])


def graph_page_rank(edges: DataFrame, restart: DataFrame, steps: int, alpha: float = RESTART, every: int = 4, tolerance: float | None = None, most: int = 2_000_000) -> DataFrame:
    """``page_rank`` of many small graphs (qid, run, src, dst; undirected): the edges of each (qid, run) meet in one task and the walk goes on there.

    Without a column ``run`` the walks of a question share its graph. Graphs of more than ``most`` edges walk by joins.
    """
    if "run" not in edges.columns:
        edges = edges.join(restart.select("qid", "run").distinct(), "qid")
    keys = ("qid", "run")
    edges = edges.select(*keys, "src", "dst").filter("src is not null and dst is not null")
    near, far = apart(edges, keys, most)

    def work(key: tuple, links: pa.Table, starts: pa.Table) -> pa.Table:
        nodes, src, dst, at = numbered(links, starts["node"])
        degree = np.bincount(src, minlength=len(nodes))
        start = np.bincount(at, weights=starts["mass"].to_numpy(), minlength=len(nodes))
        mass, bare, size = start, degree == 0, max(1, int((degree > 0).sum()))
        for k in range(1, steps + 1):
            spread = (1 - alpha) * mass / np.maximum(degree, 1)
            new = np.bincount(dst, weights=spread[src], minlength=len(nodes)) + (alpha + (1 - alpha) * mass[bare].sum()) * start
            gap, mass = np.abs(new - mass).sum(), new
            if tolerance is not None and k % every == 0 and gap < tolerance * size:
                break
        kept = np.flatnonzero(mass > 0)
        return pa.table({"qid": pa.repeat(key[0], len(kept)), "run": pa.repeat(key[1], len(kept)), "node": nodes.take(pa.array(kept)), "mass": mass[kept]})

    schema = StructType([StructField(k, restart.schema[k].dataType) for k in keys] + [StructField("node", StringType()), StructField("mass", DoubleType())])
    if far is None:
        return meet(near, restart, keys, work, schema)
    large = cut(far.select(*keys).distinct())
    found = meet(near, restart.join(large, list(keys), "left_anti"), keys, work, schema)
    both = cut(far.union(far.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    return found.union(page_rank(both, restart.join(large, list(keys), "left_semi").select(*keys, "node", "mass"), steps, alpha, every=every, tolerance=tolerance).select(*found.columns))


def push_table(adjacent: DataFrame, most: int = 10_000) -> DataFrame:
    """One graph laid out for pushes of any number of walkers: src, part, dst, ends, parts.

    A node of more than ``most`` neighbours is split into parts, so no task
    holds a hub whole; ``ends`` and ``parts`` are the neighbours and parts of
    ``dst``. Dealt and sorted by (src, part) and kept that way, so that the
    rounds of a push bring their rows to it and never shuffle it again.
    """
    spark = adjacent.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    degree = cut(adjacent.groupBy("src").agg(F.count(F.lit(1)).alias("deg")))
    parts = F.ceil(F.col("deg") / most).cast("int")
    # every node but hubs is one part, so the first join meets few nodes; the second has one row a node on its side, and hot ones are split at run time
    hubs = small(degree.filter(F.col("deg") > most).select("src", parts.alias("own")))
    into = degree.select(F.col("src").alias("dst"), F.col("deg").alias("ends"), parts.alias("parts"))
    own = F.coalesce("own", F.lit(1))
    dealt = cut(adjacent.join(hubs, "src", "left").join(into, "dst").select("src", F.pmod(F.xxhash64("dst"), own).cast("int").alias("part"), "dst", "ends", "parts"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a checkpoint keeps the partitioning of a plan that cannot change any more
    try:
        table = cut(dealt.repartition(width, "src", "part").sortWithinPartitions("src", "part"))
        for over in (dealt, degree):
            release(over)
        return table
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def push_round(state: DataFrame, table: DataFrame, ready: Column, alpha: float = RESTART) -> DataFrame:
    """One round of pushes; state: qid, node, mass, residual, ends, parts, and ``ready`` says which rows spread."""
    # part -1 carries a row's own state past the edges; the other parts meet the edges of the node
    parts = F.concat(F.array(F.lit(-1)), F.when(ready, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array().cast("array<int>")))
    sent = state.select("*", ready.alias("ready"), F.explode(parts).alias("part")).withColumnRenamed("node", "src").withColumnsRenamed({"ends": "own_ends", "parts": "own_parts"})
    met = sent.join(table, ["src", "part"], "left")
    own = F.col("part") == -1
    moved = met.select(
        "qid",
        F.when(own, F.col("src")).otherwise(F.col("dst")).alias("node"),
        F.when(own, F.col("mass") + F.when(F.col("ready"), alpha * F.col("residual")).otherwise(0.0)).otherwise(0.0).alias("mass"),
        F.when(own, F.when(F.col("ready"), 0.0).otherwise(F.col("residual"))).otherwise((1 - alpha) * F.col("residual") / F.col("own_ends")).alias("residual"),
        F.when(own, F.col("own_ends")).otherwise(F.col("ends")).alias("ends"),
        F.when(own, F.col("own_parts")).otherwise(F.col("parts")).alias("parts"),
    ).filter("node is not null")
    return moved.groupBy("qid", "node").agg(F.sum("mass").alias("mass"), F.sum("residual").alias("residual"), F.first("ends").alias("ends"), F.first("parts").alias("parts"))


def forward_push(table: DataFrame, restart: DataFrame, tolerance: float = 1e-4, alpha: float = RESTART, wide: float = 0.1, every: int = 2, rounds: int = 400, settle: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Personalized PageRank of many walkers over one undirected graph: qid, node, mass, each within ``tolerance``.

    table: ``push_table`` of the graph; restart: qid, node, mass (nodes outside
    the graph are left out, and a walker without nodes has no rows).

    A walker keeps settled mass and a residual for each node it has reached.
    In a round every residual of at least epsilon a neighbour leaves its share
    alpha behind and spreads the rest; the others wait, so a walker touches
    1 / (alpha * epsilon) edges at most, however large the graph. Residuals
    below epsilon a neighbour take at most epsilon * (neighbours of u) from the
    mass of a node u; epsilon is tolerance / (largest number of neighbours).

    A walker that has reached more than the share ``wide`` of the nodes goes
    on in ``wide_push`` from what it has. Looked up every ``every`` rounds;
    raises where walkers are left after ``rounds``.
    """
    known = settle(table.groupBy(F.col("dst").alias("node")).agg(F.first("ends").alias("ends"), F.first("parts").alias("parts")))
    state = settle(restart.groupBy("qid", "node").agg(F.sum("mass").alias("residual")).join(known, "node").select("qid", "node", F.lit(0.0).alias("mass"), "residual", "ends", "parts"))
    largest, nodes = known.agg(F.max("ends"), F.count(F.lit(1))).first()
    if largest is None:
        return state.select("qid", "node", "mass")
    ready = F.col("residual") >= F.col("ends") * F.lit(tolerance / largest)
    done, reached, state_cut = [], [], state  # state_cut: the last cut that the next one replaces
    for k in range(1, rounds + 1):
        state = push_round(state, table, ready, alpha)
        if k % every and k < rounds:
            continue
        before, state = state_cut, settle(state)
        release(before)
        state_cut = state
        fate = F.when(F.count_if(ready) == 0, "done").when(F.count(F.lit(1)) > wide * nodes, "wide").otherwise("going")
        walkers = settle(state.groupBy("qid").agg(fate.alias("fate")))
        counts = dict(walkers.groupBy("fate").count().collect())
        if counts.get("going", 0) < sum(counts.values()):
            told = state.join(small(walkers), "qid")
            done.append(told.filter("fate = 'done'").select("qid", "node", "mass"))
            if "wide" in counts:
                reached.append(told.filter("fate = 'wide'").drop("fate"))
            # this cut stays: the walkers that end here are read from it
            state = state_cut = settle(told.filter("fate = 'going'").drop("fate")) if "going" in counts else None
        if not counts.get("going"):
            break
    else:
        raise RuntimeError(f"walkers are left after {rounds} rounds; raise rounds or the tolerance")
    if reached:
        done.append(wide_push(table, reduce(DataFrame.union, reached), tolerance, largest, alpha, settle=settle))
    return reduce(DataFrame.union, done) if done else state.select("qid", "node", "mass")


def wide_push(table: DataFrame, state: DataFrame, tolerance: float, largest: int, alpha: float = RESTART, together: int = 16, settle: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """The rest of walks that fill the graph: qid, node, mass, from the state of ``push_round``.

    Up to ``together`` walkers share the rows of a block, a column each, so an
    edge is met once for all of them. The residuals are solved for by the
    second-order Richardson iteration for a symmetric walk, whose values lie
    within b = 1 - alpha of zero; its factors are the same in all rounds, so the
    rounds share their compiled code. Over nodes weighed by 1 / neighbours, a
    residual of norm t leaves an error of at most t * sqrt(neighbours of u) at
    u, and k rounds shrink it to q^k * (1 + k * sqrt(1 - b^2)) of it or less,
    with q = (1 - sqrt(1 - b^2)) / b; so the number of rounds is known before
    the first.
    """
    ids = state.select("qid").distinct()
    n = ids.count()
    if not n:
        return state.select("qid", "node", "mass")
    shelves = -(-n // 4096)  # numbered apart, so no task numbers all walkers
    each = min(together, n)
    place = F.row_number().over(Window.partitionBy("shelf").orderBy("qid")) - 1
    seats = settle(
        ids.withColumn("shelf", F.pmod(F.xxhash64("qid"), F.lit(shelves))).withColumn("place", place)
        .select("qid", (F.col("shelf") * (1 << 32) + F.floor(F.col("place") / each)).alias("block"), (F.col("place") % each).alias("seat"))
    )
    norm = state.groupBy("qid").agg(F.sqrt(F.sum(F.col("residual") * F.col("residual") / F.col("ends"))).alias("norm")).agg(F.max("norm")).first()[0]
    reach = 1 - alpha
    root = math.sqrt(1 - reach * reach)
    q, goal = (1 - root) / reach, tolerance / math.sqrt(largest)
    rounds = next(k for k in itertools.count() if norm * q**k * (1 + k * root) <= goal)
    at, slots = ["block", "node"], range(each)
    of = lambda name, value: [F.sum(F.when(F.col("seat") == i, value).otherwise(0.0)).alias(f"{name}{i}") for i in slots]
    # x: settled mass in units of alpha; r: residual; d: the step to take
    now = state.join(small(seats), "qid").groupBy(*at).agg(F.first("ends").alias("ends"), F.first("parts").alias("parts"), *of("x", F.col("mass") / alpha), *of("r", F.col("residual")), *of("d", F.col("residual")))
    now = settle(now)
    for _ in range(rounds):
        sent = now.select("block", F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *((reach * F.col(f"d{i}") / F.col("ends")).alias(f"d{i}") for i in slots))
        met = sent.join(table, ["src", "part"]).groupBy("block", F.col("dst").alias("node"))
        moved = met.agg(F.first("ends").alias("to_ends"), F.first("parts").alias("to_parts"), *(F.sum(f"d{i}").alias(f"m{i}") for i in slots))
        both = now.join(moved, at, "full_outer").fillna(0.0, [f"{c}{i}" for c in "xrdm" for i in slots])
        left = both.select(*at, F.coalesce("ends", "to_ends").alias("ends"), F.coalesce("parts", "to_parts").alias("parts"), *((F.col(f"x{i}") + F.col(f"d{i}")).alias(f"x{i}") for i in slots), *((F.col(f"r{i}") - F.col(f"d{i}") + F.col(f"m{i}")).alias(f"r{i}") for i in slots), *(f"d{i}" for i in slots))
        before, now = now, settle(left.select(*at, "ends", "parts", *(f"{c}{i}" for c in "xr" for i in slots), *((q * q * F.col(f"d{i}") + (1 + q * q) * F.col(f"r{i}")).alias(f"d{i}") for i in slots)))
        release(before)
    single = now.select(*at, F.posexplode(F.array(*(alpha * F.col(f"x{i}") for i in slots))).alias("seat", "mass")).filter("mass > 0")
    return single.join(small(seats), ["block", "seat"]).select("qid", "node", "mass")


def drop_edges(edges: DataFrame, runs: int, share: float = 0.1) -> DataFrame:
    """Perturbed copies of a graph: a stable hash of run and edge drops a share of the edges, the same in every engine."""
    run = edges.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    draw = F.conv(F.substring(F.sha1(F.concat_ws("|", "run", "qid", F.least("src", "dst"), F.greatest("src", "dst"))), 1, 8), 16, 10).cast("long")
    return run.filter(draw >= F.lit(int(share * (1 << 32))))


def random_walks(adjacent: DataFrame, sources: DataFrame, walks: int = 512, steps: int = 24, alpha: float = RESTART, seed: int = 0, settle: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Monte-Carlo PageRank: visit shares of walks that restart with chance alpha or at a dead end. Draws are hashes, so reruns agree."""
    degree = adjacent.groupBy("qid", "src").agg(F.count(F.lit(1)).alias("ends"))
    placed = adjacent.withColumn("place", F.row_number().over(Window.partitionBy("qid", "src").orderBy("dst")) - 1)
    # one row a neighbour, with its own number of neighbours: a walker meets the one it goes to, never a hub's list
    near = settle(placed.join(degree.withColumnRenamed("src", "dst"), ["qid", "dst"], "left").select("qid", F.col("src").alias("node"), "place", "dst", F.coalesce("ends", F.lit(0)).alias("dst_ends")))
    known = sources.join(degree.withColumnRenamed("src", "source"), ["qid", "source"], "left").select("qid", "source", F.coalesce("ends", F.lit(0)).alias("home"))
    at = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.col("source").alias("node"), F.col("home").alias("ends"), F.array("source").alias("seen"))
    visits = None
    for k in range(steps):
        draw = lambda salt, k=k: F.pmod(F.xxhash64("qid", "source", "walk", F.lit(seed), F.lit(k), F.lit(salt)), F.lit(1 << 30)) / (1 << 30)
        on = at.withColumn("place", F.when((draw(0) >= alpha) & (F.col("ends") > 0), F.floor(draw(1) * F.col("ends")).cast("int")))
        node, ends = F.coalesce("dst", "source"), F.when(F.col("dst").isNull(), F.col("home")).otherwise(F.col("dst_ends"))
        at = on.join(near, ["qid", "node", "place"], "left").select("qid", "source", "home", "walk", node.alias("node"), ends.alias("ends"), F.concat("seen", F.array(node)).alias("seen"))
        if k % 4 == 3 or k == steps - 1:
            at = settle(at)
            some = at.select("qid", "source", F.explode("seen").alias("node"))
            visits, at = visits.union(some) if visits else some, at.withColumn("seen", F.array().cast("array<string>"))
    visits = at.select("qid", "source", F.explode("seen").alias("node")) if visits is None else visits
    return visits.groupBy("qid", "source", "node").agg((F.count(F.lit(1)) / (walks * (steps + 1))).alias("score"))


def engine(global_scope: bool, nodes: int, choice: str = "auto") -> str:
    """Power iteration, or walks for global graphs of 50,000 nodes and more."""
    return choice if choice != "auto" else ("mc" if global_scope and nodes >= 50_000 else "power")


def top_nodes(ranked: DataFrame, most: int, keys: tuple[str, ...] = ("qid", "run"), score: str = "mass") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "node")).cast("long")
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= most)
