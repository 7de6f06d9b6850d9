"""Chunks and the sentences that they contain, against testing every pair."""

from __future__ import annotations

import random

from threadloom.operators import graph


def test_pairs_equal_every_pair():
    """Sentences of one word to many, inside words, over chunk ends, repeated, empty, and with line ends."""
    r = random.Random(3)
    for _ in range(300):
        words = [r.choice(("a", "b", "ab", "ba", "abc", "c\nd", "")) for _ in range(r.randint(0, 60))]
        chunks = [" ".join(words[i : i + r.randint(1, 12)]) for i in range(0, len(words), r.randint(1, 5))]
        sentences = [" ".join(words[i : i + r.randint(0, 6)]) for i in range(len(words))] + ["b a", "a", "b\na", "a b c"]
        want = sorted((j, i) for j, c in enumerate(chunks) for i, s in enumerate(sentences) if s and s in c)
        assert sorted(graph.pairs_in(chunks, sentences)) == want
    assert not list(graph.pairs_in([], ["a"])) and not list(graph.pairs_in(["a"], []))


def test_no_join_and_odd_rows(spark):
    texts = ["Amber Falls is old. Yes. Amber Falls is old. Is old.", None, "", "One", " ".join(f"Line {i % 40} of a long text." for i in range(900))]
    docs = spark.createDataFrame([*enumerate(texts), (None, "Lone text. No id.")], "doc_id long, text string")
    edges = graph.containment_edges(docs)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = sorted((e["src"], e["dst"]) for e in edges.collect())
    chunks = [(c["doc_id"], c["unit_idx"], c["text"]) for c in graph.chunk_table(docs).collect()]
    sents = [(s["doc_id"], s["unit_idx"], " ".join(s["text"].split())) for s in graph.sentence_table(docs).collect()]
    want = sorted((f"c::{d}:{i}", f"s::{d}:{k}") for d, i, c in chunks if d is not None for e, k, s in sents if e == d and s and s in c)
    assert got == want and len(got) > 1_000
