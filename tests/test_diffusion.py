"""The registered walks against power iteration in Python, by the reference's settings."""

from __future__ import annotations

from types import SimpleNamespace

from threadloom.operators import diffusion, graph
from threadloom.plans import queries


def brute(edges, sources, steps=2000):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    start = {s: 1 / len(sources) for s in sources}
    rank = dict(start)
    for _ in range(steps):
        new = {n: 0.15 * start.get(n, 0.0) for n in near}
        for n, m in rank.items():
            for x in near[n]:
                new[x] += 0.85 * m / len(near[n])
        rank = new
    return rank


PATH, STAR = [(f"p{i}", f"p{i + 1}") for i in range(11)], [("c", f"l{i}") for i in range(5)]


def stub(spark, questions):
    edges = [(q, a, b) for q, (e, _) in questions.items() for a, b in e]
    sources = [(q, s) for q, (_, ss) in questions.items() for s in ss]
    adjacent = graph.both_ways(spark.createDataFrame(edges, "qid long, src string, dst string"), ("qid",))
    return SimpleNamespace(adjacent=adjacent, sources=spark.createDataFrame(sources, "qid long, source string"))


def test_converged_page_rank(spark):
    questions = {1: (PATH, ["p0", "p4"]), 2: (STAR, ["c"])}
    got = queries.ppr_converged(stub(spark, questions)).collect()
    for q, (edges, sources) in questions.items():
        want = brute(edges, sources)
        found = {r["node"]: r["mass"] for r in got if r["qid"] == q}
        assert len(found) == min(10, len(want)) and all(abs(m - want[n]) < 1.5e-4 for n, m in found.items())


def test_each_question_settles_on_its_own(spark):
    """Neither the stop nor the mass of a question depends on the others, and the tolerance counts for each."""
    r = stub(spark, {1: (PATH, ["p0"]), 2: ([("x", "y")], ["x"]), 3: (STAR, ["l0"])})
    both = diffusion.page_rank(r.adjacent, diffusion.restart_vector(r.sources.withColumn("run", diffusion.F.lit(0))), 100, tolerance=0.1).collect()
    one = stub(spark, {2: ([("x", "y")], ["x"])})
    alone = diffusion.page_rank(one.adjacent, diffusion.restart_vector(one.sources.withColumn("run", diffusion.F.lit(0))), 100, tolerance=0.1).collect()
    assert sorted((x["node"], round(x["mass"], 12)) for x in both if x["qid"] == 2) == sorted((x["node"], round(x["mass"], 12)) for x in alone)
    assert {x["qid"] for x in both} == {1, 2, 3}
    assert abs(sum(x["mass"] for x in both) - 3) < 1e-9


def test_random_walks_take_all_walks_and_steps(spark):
    got = queries.random_walks(stub(spark, {1: (STAR, ["c"])})).collect()
    want = brute(STAR, ["c"])
    total = 512 * 25  # the start counts as a visit
    assert all(abs(r["score"] * total - round(r["score"] * total)) < 0.02 for r in got) and abs(sum(r["score"] for r in got) - 1) < 1e-5
    assert all(abs(r["score"] - want[r["node"]]) < 0.03 for r in got)


def walkers(spark, rows):
    return spark.createDataFrame(rows, "qid long, node string, mass double")


def one_graph(spark, edges):
    return graph.both_ways(spark.createDataFrame(edges, "src string, dst string"))


def test_push_stays_within_its_tolerance(spark):
    """Graphs with and without two sides, whole and in two pieces, hubs whole and in parts; narrow rows to the end, and wide ones."""
    crossed = PATH + [("hub", f"p{i}") for i in range(0, 11, 2)] + [("p0", "p2")]
    two_sided = [(f"a{i}", f"b{(i * k) % 7}") for i in range(9) for k in (1, 2, 5)]
    whole = {"p0": 0.5, "p4": 0.5}, {"a1": 0.25, "b3": 0.75}
    for edges, start, most, wide in ((crossed, whole[0], 10_000, 0.1), (two_sided, whole[1], 2, 2.0), (crossed + STAR, whole[0], 2, 0.7)):
        rows = [(2**62, n, m) for n, m in start.items()] + [(2**53 + 1, next(iter(start)), 1.0)]
        got = diffusion.forward_push(diffusion.push_table(one_graph(spark, edges), most), walkers(spark, rows), tolerance=1e-3, wide=wide).collect()
        for q in (2**62, 2**53 + 1):
            want = brute(edges, list(start) if q == 2**62 else [next(iter(start))], 300) if q != 2**62 or len(set(start.values())) == 1 else mixed(edges, start)
            mine = {r["node"]: r["mass"] for r in got if r["qid"] == q}
            assert len(mine) == sum(r["qid"] == q for r in got)
            assert all(abs(want[n] - m) <= 1e-3 for n, m in mine.items())
            assert all(m <= 1e-3 for n, m in want.items() if n not in mine)


def test_wide_walkers_in_many_blocks(spark):
    """More walkers than a block has columns, weights of any size, hubs in parts: each within the tolerance."""
    edges = PATH + [("hub", f"p{i}") for i in range(11)]
    starts = {q: {f"p{q % 12}": 0.5, "hub": 0.5} for q in range(19)} | {40: {"p3": 1e-7}, 41: {"p3": 5.0}}
    table = diffusion.push_table(one_graph(spark, edges), 3)
    state = walkers(spark, [(q, n, m) for q, s in starts.items() for n, m in s.items()])
    got = diffusion.forward_push(table, state, tolerance=1e-5, wide=0.0).collect()
    assert len({(r["qid"], r["node"]) for r in got}) == len(got)
    mine = {(r["qid"], r["node"]): r["mass"] for r in got}
    for q, start in starts.items():
        assert all(abs(m - mine.get((q, n), 0.0)) <= 1e-5 for n, m in mixed(edges, start).items())


def mixed(edges, start):
    """By linearity: the walk of a weighted start is the weighted sum of single walks."""
    walks = [(m, brute(edges, [n], 300)) for n, m in start.items()]
    return {n: sum(m * w[n] for m, w in walks) for n in walks[0][1]}


def test_push_touches_what_it_reaches(spark):
    """A walker leaves far nodes of a long path alone, and rows outside the graph have no walk."""
    long_path = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(400)]
    got = diffusion.forward_push(diffusion.push_table(one_graph(spark, long_path)), walkers(spark, [(1, "n000", 1.0), (2, "nowhere", 1.0)]), wide=0.5).collect()
    assert {r["qid"] for r in got} == {1} and len(got) < 80
    empty = diffusion.forward_push(diffusion.push_table(one_graph(spark, long_path).limit(0)), walkers(spark, [(1, "n000", 1.0)]))
    assert empty.count() == 0


def test_push_never_shuffles_its_edges_again(spark):
    """The plan of a round brings the walkers to the edges: no exchange above the table's own scan."""
    F = diffusion.F
    table = diffusion.push_table(one_graph(spark, PATH))
    state = walkers(spark, [(1, "p0", 1.0)]).select("qid", "node", F.lit(0.0).alias("mass"), F.col("mass").alias("residual"), F.lit(1).cast("long").alias("ends"), F.lit(1).alias("parts"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = diffusion.push_round(diffusion.push_round(state, table, F.col("residual") > 0), table, F.col("residual") > 0)
        plan = moved._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # two rounds: each shuffles its rows to the edges and then by walker and node, never the edges
    assert plan.count("Exchange hashpartitioning(src") == 2 and plan.count("Exchange hashpartitioning(qid") == 2 and plan.count("Exchange") == 4, plan


def test_corpus_diffusion_equals_power_iteration(spark):
    from threadloom.plans.binding import Retrieval

    texts = ["Amber Falls lies near Birch Town. Birch Town trades with Cedar Port.", "Cedar Port ships amber to Delta City.", "Delta City hosts the Elm Fair.", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = Retrieval(spark.createDataFrame([(7, "Where is Birch Town?"), (8, "Who hosts the Elm Fair near Cedar Port?"), (9, None)], "qid long, text string"), docs)
    edges = [(e["src"], e["dst"]) for e in graph.corpus_graph(docs).collect()]
    got = queries.corpus_diffusion(r).collect()
    asked = {}
    for row in r.corpus_sources.collect():
        asked.setdefault(row["qid"], []).append(row["node"])
    assert set(asked) == {7, 8} == {x["qid"] for x in got}
    for q, sources in asked.items():
        want, mine = brute(edges, sources, 300), [x for x in got if x["qid"] == q]
        assert len(mine) == min(20, len(want)) and all(abs(x["mass"] - want[x["node"]]) < 1.6e-4 for x in mine)
        best = sorted(want.values(), reverse=True)[: len(mine)]
        assert all(abs(x["mass"] - b) < 1.6e-4 for x, b in zip(sorted(mine, key=lambda x: x["rank"]), best, strict=True))


def test_rounds_that_are_over_leave_no_files(spark):
    """A round's state is deleted once the next one is cut; what is still read stays."""
    made = []
    cut = diffusion.cut

    def watched(df):
        out = cut(df)
        made.append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
        return out

    path = [(f"e::{i}", f"c::{i + 1}") for i in range(0, 40, 2)] + [(f"c::{i}", f"e::{i + 1}") for i in range(1, 40, 2)]
    both = graph.both_ways(spark.createDataFrame(path, "src string, dst string"))
    start = spark.createDataFrame([(1, "e::0", 1.0), (2, "e::20", 1.0)], "qid long, node string, mass double")
    table = diffusion.push_table(both)
    kept = {}
    for wide in (0.1, 2.0):
        made.clear()
        out = diffusion.forward_push(table, start, wide=wide, settle=watched)
        kept[wide] = {(r["qid"], r["node"]): r["mass"] for r in out.collect()}
        here = [f for f in made if spark._jvm.org.apache.hadoop.fs.Path(f).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f))]
        assert len(made) > 10 and len(here) < 0.75 * len(made)
    assert all(abs(kept[0.1].get(k, 0.0) - m) <= 2e-4 for k, m in kept[2.0].items())
