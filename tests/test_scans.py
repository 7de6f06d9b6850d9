"""Stages over all documents keep their texts and tokens where they are."""

from __future__ import annotations

from threadloom.operators import graph
from threadloom.plans.binding import Retrieval

TEXTS = ["The red fox met a blue whale. It swam.", "A red herring, and 12 of them.", "Nothing here but of the and.", "", None]


def test_hits_are_made_once(spark):
    questions = spark.createDataFrame([(1, "red fox"), (2, "blue whale")], "qid long, text string")
    r = Retrieval(questions, spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert r.hits._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRDD"
    assert {(x["qid"], x["doc_id"]) for x in r.contexts.collect()} == {(1, 0), (1, 1), (2, 0)}


def test_signature_makes_no_edges(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = sorted(r[0] for r in graph.corpus_graph(docs).select("src").distinct().collect())
    assert sorted(r[0] for r in graph.linked_chunks(docs).collect()) == want
