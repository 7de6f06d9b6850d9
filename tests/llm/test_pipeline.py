"""The pipeline on a small folder: each stage works on what its predecessor kept."""

from __future__ import annotations

import random

import corpus_pipeline
from threadloom.llm import queries


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    for i in range(200):
        toxic = i % 5 == 0
        words = make(80) + (["awful", "rotten", "vile"] if toxic else [])
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    near = rows[1][1].split(" ")
    near[5] = "changed"
    rows += [(300, rows[1][1], "en", "s", 1), (301, " ".join(near), "en", "s", 1), (302, "too short", "en", "s", 1), (303, None, None, None, None)]
    rows += [(304, " ".join(make(60)) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b90"', "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
        if k < 4:
            assert docs.columns == columns
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {302, 303}.isdisjoint(seen["quality_rules"]) and len(seen["quality_rules"]) >= 200
    assert {300, 301}.isdisjoint(seen["near_duplicates"]) and 1 in seen["near_duplicates"]
    assert "[secret]" in texts[304] and seen["secret_scans"] == seen["near_duplicates"]
    toxic = {i for i in range(0, 200, 5)}
    assert len(seen["mixing_to_targets"] & toxic) <= 4
    assert len(seen["mixing_to_targets"] - toxic) >= 0.97 * len(seen["secret_scans"] - toxic)
    assert seen["sequence_packing"] == seen["mixing_to_targets"]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_on_odd_tables(spark, tmp_path):
    """An empty table, null and repeated ids, and columns with the operators' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, rate double, kept boolean, rep long, node long, __row string"
    text = "one two three four five six seven eight nine ten eleven twelve"
    row = lambda i, t: (i, t, "en", None, None, 0.5, False, 1, 2, "r")
    tables = {"empty": [], "odd": [row(None, text), row(None, None), row(1, text), row(1, text), row(2, text + " more"), row(3, "")]}
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, rows in tables.items():
        docs = spark.createDataFrame(rows, schema)
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, docs, str(tmp_path))
            assert (out.columns == docs.columns) == (stage != "sequence_packing")
            found = out.count()
            assert (found == 0) == (name == "empty") and (found <= len(rows) or stage == "sequence_packing"), (name, stage)
    odd = spark.createDataFrame(tables["odd"], schema)
    assert corpus_pipeline.quality_rules(spark, odd, str(tmp_path)).count() == 4  # two have too few words
    assert corpus_pipeline.near_duplicates(spark, odd, str(tmp_path)).filter("doc_id = 1").count() == 1
    # one label tells next to nothing, so rates lie between zero and one; rows of one id are drawn together
    drawn = [r["doc_id"] for r in corpus_pipeline.mixing_to_targets(spark, odd, str(tmp_path)).collect()]
    assert drawn.count(1) in (0, 2) and drawn.count(None) in (0, 2)
