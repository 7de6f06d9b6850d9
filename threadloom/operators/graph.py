"""Heterogeneous text graphs as tables.

``edges(src, dst, edge_type, support_layer)`` holds every undirected edge once;
``both_ways`` gives the symmetric view. Graphs of one question each carry
``qid`` as their first key, so all questions are built and walked together.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T


def sentence_node(doc: Column, index: Column) -> Column:
    return F.concat(F.lit("s::"), doc.cast("string"), F.lit(":"), index.cast("string"))


def chunk_node(doc: Column, index: Column) -> Column:
    return F.concat(F.lit("c::"), doc.cast("string"), F.lit(":"), index.cast("string"))


def entity_node(token: Column) -> Column:
    return F.concat(F.lit("e::"), token)


def sentence_table(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per sentence: the keys, ``unit_idx``, ``text``."""
    return docs.select(*keys, F.posexplode(T.sentences(F.col(text))).alias("unit_idx", "text"))


def chunk_table(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", **window: int) -> DataFrame:
    return docs.select(*keys, F.posexplode(T.passage_chunks(F.col(text), **window)).alias("unit_idx", "text"))


def mentions(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct entity tokens of each unit."""
    return units.select(*keys, F.explode(F.array_distinct(T.entity_tokens(F.col("text")))).alias("token"))


def question_graph(contexts: DataFrame) -> DataFrame:
    """Per question: sentences of its context documents, adjacent ones joined, and mentions of entities."""
    units = sentence_table(contexts, ("qid", "doc_id"))
    node = sentence_node(F.col("doc_id"), F.col("unit_idx"))
    w = Window.partitionBy("qid", "doc_id").orderBy("unit_idx")
    follows = units.select("qid", node.alias("src"), F.lead(node).over(w).alias("dst")).filter("dst is not null").withColumn("edge_type", F.lit("adjacent"))
    named = mentions(units, ("qid", "doc_id", "unit_idx")).select("qid", node.alias("src"), entity_node(F.col("token")).alias("dst"), F.lit("mentions").alias("edge_type"))
    return follows.unionByName(named)


def corpus_graph(docs: DataFrame, **window: int) -> DataFrame:
    """Edges of the passage layer: chunks and the entities they support."""
    units = chunk_table(docs, **window)
    return mentions(units, ("doc_id", "unit_idx")).select(
        chunk_node(F.col("doc_id"), F.col("unit_idx")).alias("src"), entity_node(F.col("token")).alias("dst"), F.lit("entity_chunk_support").alias("edge_type"), F.lit("entity_chunk").alias("support_layer")
    )


def linked_chunks(docs: DataFrame, **window: int) -> DataFrame:
    """Chunk nodes of the corpus graph, those with an entity: one row a chunk, its edges are not made."""
    units = chunk_table(docs, **window).filter(F.size(T.entity_tokens(F.col("text"))) > 0)
    return units.select(chunk_node(F.col("doc_id"), F.col("unit_idx")).alias("node"))


def linked_units(docs: DataFrame, **window: int) -> DataFrame:
    """``corpus_graph`` by chunk: node, linked (its entities). Documents without an id have no nodes; only where ids repeat are the rows of one document brought together."""
    kept = docs.select("doc_id", "text").filter("doc_id is not null")
    rows, ids = kept.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    units = chunk_table(kept if rows == ids else kept.repartition("doc_id"), **window)
    named = units.select("doc_id", "unit_idx", F.array_distinct(T.entity_tokens(F.col("text"))).alias("tokens"))
    if rows != ids:
        named = named.groupBy("doc_id", "unit_idx").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    return named.select(chunk_node(F.col("doc_id"), F.col("unit_idx")).alias("node"), F.transform("tokens", entity_node).alias("linked"))


def sentence_layer(docs: DataFrame) -> DataFrame:
    units = sentence_table(docs)
    return mentions(units, ("doc_id", "unit_idx")).select(
        sentence_node(F.col("doc_id"), F.col("unit_idx")).alias("src"), entity_node(F.col("token")).alias("dst"), F.lit("mentions").alias("edge_type"), F.lit("sentence").alias("support_layer")
    )


def pairs_in(chunks: Sequence[str], sentences: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Places (chunk, sentence) where a chunk's text contains a sentence's, in time that grows with their length and the pairs.

    A chunk that contains a sentence has the sentence's inner words whole and in
    order, so three of them (one, of a sentence of three or four words) say
    which chunks to test. Sentences of one or two words have no inner one and are
    looked up in all chunks at once. Empty sentences are in no chunk.
    """
    having: dict[tuple[str, ...], list[int]] = {}
    for j, chunk in enumerate(chunks):
        words = chunk.split(" ")
        for part in {*zip(words), *zip(words, words[1:], words[2:])}:  # noqa: B905
            having.setdefault(part, []).append(j)
    at: dict[str, list[int]] = {}
    for i, sentence in enumerate(sentences):
        if sentence:
            at.setdefault(sentence, []).append(i)
    starts = list(accumulate((len(c) + 1 for c in chunks), initial=0))
    joined = "\n".join(chunks)
    for sentence, places in at.items():
        words = sentence.split(" ")
        if len(words) > 2:
            found = [j for j in having.get(tuple(words[1:4] if len(words) > 4 else words[1:2]), ()) if sentence in chunks[j]]
        else:
            found, here = [], joined.find(sentence)
            while here >= 0:
                j = bisect_right(starts, here) - 1
                if here + len(sentence) <= starts[j + 1] - 1:
                    found.append(j)
                    here = joined.find(sentence, starts[j + 1])
                else:  # it runs over the chunk's end
                    here = joined.find(sentence, here + 1)
        yield from ((j, i) for j in found for i in places)


def contained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, chunk_idx, unit_idx) of documents (doc_id, chunks, sentences); some ten thousand a batch."""
    for batch in batches:
        ids, chunks, sentences = batch.columns
        for row in range(batch.num_rows):
            pairs = pairs_in(chunks[row].as_py() or [], sentences[row].as_py() or [])
            while some := list(islice(pairs, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.repeat(ids[row], len(some)), *(pa.array(side, pa.int32()) for side in zip(*some, strict=True))], ["doc_id", "chunk_idx", "unit_idx"])


def containment_edges(docs: DataFrame, **window: int) -> DataFrame:
    """Chunks and the sentences of the same document that they contain: within a document's row, without a join or shuffle. Documents without an id have no nodes."""
    whole = F.transform(T.sentences(F.col("text")), T.squash)
    units = docs.filter("doc_id is not null").select("doc_id", T.passage_chunks(F.col("text"), **window).alias("chunks"), whole.alias("sentences"))
    schema = StructType([StructField("doc_id", units.schema["doc_id"].dataType), StructField("chunk_idx", IntegerType()), StructField("unit_idx", IntegerType())])
    held = units.mapInArrow(contained, schema)
    return held.select(chunk_node(F.col("doc_id"), F.col("chunk_idx")).alias("src"), sentence_node(F.col("doc_id"), F.col("unit_idx")).alias("dst"), F.lit("chunk_contains").alias("edge_type"), F.lit("chunk").alias("support_layer"))


def entity_chunk_via_sentences(contains: DataFrame, named: DataFrame) -> DataFrame:
    """Entities joined to the chunks that contain a sentence which mentions them."""
    c, m = contains.select(F.col("src").alias("chunk"), F.col("dst").alias("sentence")), named.select(F.col("src").alias("sentence"), F.col("dst").alias("entity"))
    return c.join(m, "sentence").select(F.col("chunk").alias("src"), F.col("entity").alias("dst"), F.lit("entity_chunk_support").alias("edge_type"), F.lit("entity_chunk").alias("support_layer")).distinct()


def relation_edges(triples: DataFrame) -> DataFrame:
    """triples(unit, doc_id, item, n, subject, predicate, object): relation nodes with their unit, subject and object tokens."""
    node = F.concat_ws("::", F.lit("r"), F.col("unit"), F.col("doc_id"), F.col("item"), F.col("n"))
    unit = F.when(F.col("unit") == "chunk", chunk_node(F.col("doc_id"), F.col("item"))).otherwise(sentence_node(F.col("doc_id"), F.col("item")))
    part = lambda c, kind: triples.select(node.alias("src"), entity_node(F.explode(F.array_distinct(T.entity_tokens(F.col(c))))).alias("dst"), F.lit(kind).alias("edge_type"), F.lit("relation").alias("support_layer"))
    spoken = triples.select(node.alias("src"), unit.alias("dst"), F.lit("expressed_in").alias("edge_type"), F.lit("relation").alias("support_layer"))
    return spoken.unionByName(part("subject", "triple_subject")).unionByName(part("object", "triple_object"))


def extract_cached(units: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units answered by the extraction cache, and those still pending (a left semi and a left anti join on the key)."""
    key = F.concat_ws(":", "unit", "doc_id", "unit_idx", F.substring(F.sha1("text"), 1, 16))
    keyed = units.withColumn("cache_key", key)
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti")


def merge_parallel(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, with the largest weight of parallel ones."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").filter("src != dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def alias_nodes(names: DataFrame, most: int = 6) -> DataFrame:
    """Alias tokens (at most ``most``) of imported entities, for matching with chunk tokens."""
    clean = F.lower(F.regexp_replace("label", r"^\d+ \d+ ?", ""))
    return names.select("node", F.explode(F.slice(F.array_distinct(T.content_tokens(clean)), 1, most)).alias("token")).select("node", entity_node(F.col("token")).alias("alias"))


def both_ways(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(*keys, "src", "dst").union(back).distinct()


def degrees(adjacent: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return adjacent.groupBy(*keys, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def corpus_degrees(docs: DataFrame, **window: int) -> DataFrame:
    """``degrees`` of both ends of the corpus graph. Rows of one document are brought together before their edges are made, so what is shuffled is the documents and the counts, not the edges."""
    units = chunk_table(docs.select("doc_id", "text").filter("doc_id is not null").repartition("doc_id"), **window)
    edges = mentions(units, ("doc_id", "unit_idx")).groupBy("doc_id", "unit_idx", "token").agg(F.lit(1).alias("n"))
    chunks = edges.groupBy("doc_id", "unit_idx").agg(F.count(F.lit(1)).alias("degree")).select(chunk_node(F.col("doc_id"), F.col("unit_idx")).alias("node"), "degree")
    # chunks of documents without an id are one node, null
    bare = mentions(chunk_table(docs.filter("doc_id is null"), **window), ("doc_id",)).select("token").distinct()
    hub = bare.groupBy().agg(F.count(F.lit(1)).alias("degree")).filter("degree > 0").select(F.lit(None).cast("string").alias("node"), "degree")
    named = edges.groupBy("token").agg(F.count(F.lit(1)).alias("n")).union(bare.select("token", F.lit(1).cast("long")))
    return chunks.union(hub).union(named.groupBy("token").agg(F.sum("n").alias("degree")).select(entity_node(F.col("token")), "degree"))


def node_kind(node: Column) -> Column:
    """sentence, chunk, entity or relation, from the id's prefix."""
    return F.element_at(F.create_map(*map(F.lit, ("s", "sentence", "c", "chunk", "e", "entity", "r", "relation"))), F.substring_index(node, "::", 1))


def is_text(node: Column, index_side: bool = False) -> Column:
    """Chunk-like nodes: retrieval counts sentences among them, the index does not."""
    kind = node_kind(node)
    return (kind == "chunk") | ((kind == "sentence") & F.lit(not index_side))


def statistics(edges: DataFrame) -> DataFrame:
    """Nodes by kind and edges by type in one table: ``what``, ``kind``, ``n``."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    nodes = ends.groupBy(node_kind(F.col("node")).alias("kind")).agg(F.count_distinct("node").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return nodes.union(edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


def support_maps(edges: DataFrame, k: int = 32) -> tuple[DataFrame, DataFrame]:
    """entity -> chunks and chunk -> entities, the first ``k`` in order of id (not of score)."""
    pairs = edges.filter(F.col("support_layer").isin("entity_chunk", "")).select(F.col("dst").alias("entity"), F.col("src").alias("chunk")).distinct()

    def first(key: str, value: str) -> DataFrame:
        # a filter on the bare row number lets each task keep its first k of a group, however hot the group is
        place = F.row_number().over(Window.partitionBy(key).orderBy(value))
        return pairs.withColumn("place", place).filter(F.col("place") <= k).select(key, value, (F.col("place").cast("long") - 1).alias("rank"))

    return first("entity", "chunk"), first("chunk", "entity")
