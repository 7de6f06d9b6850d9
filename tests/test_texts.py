"""Trimmed texts, and degrees of the corpus graph without its edges being dealt."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import graph


def test_space_before_other_line_ends_stays(spark):
    """White space is trimmed at the ends of a text only, not before a line end of another alphabet."""
    row = spark.createDataFrame([("One. Two \n \u0085",)], "t string").select(T.sentences(F.col("t")).alias("s"), T.strip_space(F.col("t")).alias("w")).first()
    assert row["s"] == ["One.", "Two \n \u0085"] and row["w"] == "One. Two \n \u0085"


def test_degrees_of_the_corpus_graph(spark):
    rows = [(1, "Alpha meets beta. Beta meets gamma! Delta. Alpha end."), (1, "Alpha meets zeta."), (2, "Alpha it. Of. Of. Of."), (None, "Alpha void."), (None, "Alpha void."), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = graph.degrees(graph.both_ways(graph.corpus_graph(docs)))
    assert sorted(map(str, graph.corpus_degrees(docs).collect())) == sorted(map(str, whole.collect()))
    assert graph.corpus_degrees(docs.filter("doc_id = 3")).count() == 0
