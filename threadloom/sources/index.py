"""Stored indexes: graphs and vectors as Parquet tables in a folder named by what made them, loaded or else built.

An index is whole once its ``meta`` file is written, which comes last; a
folder without one is built anew. Encoders are providers: they turn a text
column into a vector column, so encoding stays in the plan that writes it.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import vectors as V

#: Settings that change an index; others do not make a new one.
KEYED = (
    "graph_mode", "index_chunk_unit", "passage_chunk_size_sentences", "passage_chunk_stride_sentences", "passage_chunk_min_sentences", "passage_chunk_max_chars",
    "index_layers", "support_topk_chunks", "support_topk_entities",
)


def timestamp() -> str:
    """The time now, in UTC."""
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


@dataclass(frozen=True)
class Encoder:
    """A named text encoder. ``instruction`` goes before questions only."""

    name: str
    encode: Callable[[Column], Column]
    instruction: str = ""

    def questions(self, text: Column) -> Column:
        return V.normalize(self.encode(F.concat(F.lit(self.instruction), T.query_key(text))))

    def units(self, text: Column) -> Column:
        return V.normalize(self.encode(text))


def hashed_encoder(dims: int = 64) -> Encoder:
    """A deterministic stand-in where no model is at hand."""
    return Encoder(f"hashed-{dims}", lambda text: V.hashed_encoding(text, dims))


def fingerprint(corpus: DataFrame) -> str:
    """What identifies a corpus: its rows' number and hashes, in any order."""
    part = F.conv(F.substring(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "text")), 1, 15), 16, 10).cast("decimal(38,0)")
    row = corpus.agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("s")).first()
    return hashlib.sha1(f"{row['n']}|{row['s']}".encode()).hexdigest()[:16]


def config_key(values: Mapping[str, Any], corpus: str, model: str = "") -> str:
    """The folder's name: a hash of the corpus, the settings that matter, and the encoder."""
    kept = {k: values[k] for k in KEYED if k in values}
    return hashlib.sha1(json.dumps([corpus, model, kept], sort_keys=True, default=str).encode()).hexdigest()[:16]


def corpus_graph(docs: DataFrame, values: Mapping[str, Any]) -> dict[str, DataFrame]:
    """Tables of a corpus index: nodes, edges of all layers, support maps and statistics.

    Layers (setting ``index_layers``, all by default): passage, sentence and
    containment.
    """
    window = {"size": values.get("passage_chunk_size_sentences", 3), "stride": values.get("passage_chunk_stride_sentences", 2), "least": values.get("passage_chunk_min_sentences", 2), "most_chars": values.get("passage_chunk_max_chars", 900)}
    layers = values.get("index_layers") or ("passage", "sentence", "containment")
    made = {"passage": lambda: G.corpus_graph(docs, **window), "sentence": lambda: G.sentence_layer(docs), "containment": lambda: G.containment_edges(docs, **window)}
    unknown = set(layers) - set(made)
    if unknown:
        raise ValueError(f"unknown layers: {sorted(unknown)}")
    edges = None
    for layer in layers:
        part = made[layer]().select("src", "dst", "edge_type", "support_layer")
        edges = part if edges is None else edges.unionByName(part)
    chunks = G.chunk_table(docs, **window).select(G.chunk_node(F.col("doc_id"), F.col("unit_idx")).alias("node"), "text")
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).filter(F.col("node").startswith("e::")).distinct().select("node", F.substring("node", 4, 1000).alias("text"))
    entity_chunks, chunk_entities = G.support_maps(edges.filter(F.col("edge_type") == "entity_chunk_support"), int(values.get("support_topk_chunks", 32)))
    return {"edges": edges, "nodes": chunks.union(names), "entity_chunks": entity_chunks, "chunk_entities": chunk_entities, "stats": G.statistics(edges)}


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_meta(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    at, fs = _file(spark, f"{folder}/meta")
    if not fs.exists(at):
        return None
    return json.loads(spark.read.text(f"{folder}/meta").first()["value"])


def load_or_build(spark: SparkSession, root: str, key: str, build: Callable[[], dict[str, DataFrame]], extra: Mapping[str, Any] | None = None) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """The tables of an index and its meta; built and written where the folder is not whole."""
    folder = f"{root}/{key}"
    meta = read_meta(spark, folder)
    if meta is None:
        tables = build()
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
        meta = {"key": key, "tables": sorted(tables), "created": timestamp(), **(extra or {})}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
        meta = {**meta, "loaded": False}
    else:
        meta = {**meta, "loaded": True}
    return {name: spark.read.parquet(f"{folder}/{name}") for name in meta["tables"]}, meta


def find_reusable(spark: SparkSession, root: str, corpus: str, signature: str, model: str) -> str | None:
    """A whole index's folder whose vectors fit another one: the same corpus and nodes, the same encoder first, the newest first."""
    at, fs = _file(spark, root)
    if not fs.exists(at):
        return None
    found = []
    for status in fs.listStatus(at):
        meta = read_meta(spark, status.getPath().toString()) if status.isDirectory() else None
        if meta and meta.get("corpus") == corpus and meta.get("signature") == signature and "vectors" in meta["tables"]:
            found.append((meta.get("model") == model, meta["created"], status.getPath().toString()))
    return max(found)[2] if found else None


def load_index(spark: SparkSession, root: str, docs: DataFrame, values: Mapping[str, Any], encoder: Encoder) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """Graph and vectors of a corpus: loaded if they are stored, with the vectors of a fitting index where there is one."""
    corpus = fingerprint(docs)
    graph, meta = load_or_build(spark, root, config_key(values, corpus), lambda: corpus_graph(docs, values), {"corpus": corpus})
    sign = V.signature(graph["nodes"], "node").first()
    signature = f"{sign['n']}-{sign['fingerprint']}"
    key = config_key(values, corpus, encoder.name)
    known = read_meta(spark, f"{root}/{key}")
    other = None if known else find_reusable(spark, root, corpus, signature, encoder.name)

    def vectors() -> dict[str, DataFrame]:
        if other:
            return {"vectors": spark.read.parquet(f"{other}/vectors")}
        return {"vectors": graph["nodes"].select("node", encoder.units(F.col("text")).alias("vector"))}

    stored, vector_meta = load_or_build(spark, root, key, vectors, {"corpus": corpus, "signature": signature, "model": encoder.name, "reused": bool(other)})
    return graph | stored, {"graph": meta, "vectors": vector_meta}


def question_vectors(spark: SparkSession, root: str, questions: DataFrame, encoder: Encoder) -> DataFrame:
    """qid and vector of each question; texts not yet in the stored cache are encoded and added to it."""
    path = f"{root}/questions-{encoder.name}"
    asked = questions.select("qid", F.sha1(T.query_key(F.col("text"))).alias("key"), "text")
    at, fs = _file(spark, path)
    new = asked.select("key", "text")
    if fs.exists(at):
        new = new.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    new = new.dropDuplicates(["key"]).select("key", encoder.questions(F.col("text")).alias("vector"))
    if new.limit(1).count():
        new.write.mode("append").parquet(path)
    return asked.select("qid", "key").join(spark.read.parquet(path).dropDuplicates(["key"]), "key").select("qid", "vector")


def extract(units: DataFrame, provider: Callable[[list[str]], list[str]], batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """Triples of text units by a provider, and counts of what went wrong.

    units: cache_key, text and more. A batch that fails is recorded with its
    error, so the rest goes on. Returns triples (cache_key, n, subject,
    predicate, object) and counters (what, n): units, triples, errors, units
    without a triple, and answers that could not be read.
    """
    from ..operators.generate import generate

    prompt = F.concat(F.lit("List the facts of the text as JSON triples [subject, predicate, object].\nText: "), F.col("text"))
    made = generate(units.select(F.col("cache_key").alias("qid"), prompt.alias("prompt")), provider, batch, "string").withColumnRenamed("qid", "cache_key")
    read = made.withColumn("triples", F.when(~F.col("failed"), T.parse_triples(F.col("raw"))))
    triples = read.select("cache_key", F.posexplode("triples").alias("n", "t")).select("cache_key", "n", "t.subject", "t.predicate", "t.object")
    bare = ~F.col("failed") & (F.size("triples") == 0)
    unread = bare & ~F.col("raw").rlike(r"[\[{]\s*[\]}]")
    counts = read.agg(F.count(F.lit(1)).alias("units"), F.sum(F.greatest(F.lit(0), F.size("triples"))).cast("long").alias("triples"), F.count_if("failed").alias("errors"), F.count_if(bare).alias("empty"), F.count_if(unread).alias("unreadable"))
    return triples, counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c))])).alias("what", "n"))


def top_errors(made: DataFrame, most: int = 10) -> DataFrame:
    """The commonest errors of a provider's failed rows."""
    return made.filter("failed").groupBy(F.substring("raw", 1, 200).alias("error")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(most)
