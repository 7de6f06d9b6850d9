"""Vector operators over ``array<float>`` columns: normalize, cosine, exact top-k, shortlists, fusion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .diffusion import cut

#: Queries packed into one block; a block is the unit that meets the vectors.
QUERY_BLOCK = 256


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 on null or unequal lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.when(F.size(a) == F.size(b), product), F.lit(0.0))


def normalize(v: Column) -> Column:
    """Unit length; the norm is at least 1e-12."""
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def hashed_encoding(text: Column, dims: int = 64) -> Column:
    """Deterministic stand-in for a text encoder: signed counts of hashed tokens, normalized."""
    tokens = T.tokenize(text)
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")
    sign = lambda t: F.when(F.pmod(F.xxhash64(t, F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(tokens, lambda t: slot(t) == i), F.lit(0.0), lambda s, t: s + sign(t)))
    return normalize(counts)


def leaders(q: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, by similarity, ties to smaller ids."""
    order = np.lexsort((ids, -sims, q))
    q, ids, sims = q[order], ids[order], sims[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], sims[keep]


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, shelf: int = 64 * QUERY_BLOCK) -> DataFrame:
    """For each query (qid, vector) the k nearest rows (id, vector) by rounded cosine, ties to smaller ids.

    Queries are packed into blocks and dealt to shelves of about ``shelf``
    queries; each shelf meets each partition group of the vectors in a task of
    its own, by an equi-join on both. A task holds the queries of one shelf and
    their k best rows so far; a block multiplication keeps what can still be
    among them, so pairs of rows are never materialized. Null vectors take no part.
    """
    spark = vectors.sparkSession
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, QUERY_BLOCK):
                s = b.slice(i, QUERY_BLOCK)
                m = np.asarray(s.column("vector").to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([s.column("qid").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]), pa.array([m.tobytes()]), pa.array([s.num_rows])], names=["qids", "queries", "n"])

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            is_query = b.column("qids").is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(is_query):
                qids = np.frombuffer(b.column("qids")[i].as_py(), np.int64)
                q = np.frombuffer(b.column("queries")[i].as_py()).reshape(len(qids), -1)
                asked.append((qids, q))
                found.append((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)))
            rows = b.filter(pa.array(~is_query))
            if not rows.num_rows:
                continue
            ids = rows.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            m = np.asarray(rows.column("vector").to_pylist(), np.float64)
            norm = np.maximum(np.sqrt((m * m).sum(1)), 1e-12)
            last = min(k, len(ids)) - 1
            for i, (_, q) in enumerate(asked):
                sim = np.round(q @ m.T / np.maximum(np.sqrt((q * q).sum(1)), 1e-12)[:, None] / norm[None, :], digits)
                sim[np.isnan(sim)] = -np.inf
                floor = np.partition(sim, sim.shape[1] - 1 - last, axis=1)[:, -1 - last]
                at, col = np.nonzero(sim >= floor[:, None])
                new = (at, ids[col], sim[at, col])
                found[i] = leaders(*(np.concatenate(x) for x in zip(found[i], new, strict=True)), k)
        for (qids, _), (at, ids, sims) in zip(asked, found, strict=True):
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(ids), pa.array(np.where(np.isneginf(sims), np.nan, sims))], names=["qid", "id", "sim"])

    packed = cut(queries.select(F.col("qid").cast("long").alias("qid"), "vector").filter("vector is not null").mapInArrow(pack, "qids binary, queries binary, n long"))
    shelves = -(-(packed.agg(F.sum("n")).first()[0] or 1) // shelf)
    row = F.pmod(F.xxhash64("qids"), F.lit(shelves)).cast("int") * groups
    left = packed.select(F.explode(F.sequence(row, row + (groups - 1))).alias("group"), F.lit(0).alias("kind"), "qids", "queries", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"))
    mine = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    right = vectors.filter("vector is not null").select(F.explode(F.sequence(mine, mine + groups * (shelves - 1), F.lit(groups))).alias("group"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("qids"), F.lit(None).cast("binary").alias("queries"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    met = left.unionByName(right).repartitionById(groups * shelves, F.col("group")).sortWithinPartitions("kind").mapInArrow(best, "qid long, id long, sim double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id")).cast("long")
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def rerank(shortlist: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Dense scores of a shortlist (qid, id): equi-joins fetch the vectors, then the k best stay."""
    joined = shortlist.select("qid", "id").distinct().join(vectors.select("id", F.col("vector").alias("v")), "id").join(queries.select("qid", F.col("vector").alias("q")), "qid")
    scored = joined.select("qid", "id", F.round(dot("q", "v"), 6).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id")).cast("long")
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def two_tier(shortlist: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, enough: int) -> DataFrame:
    """Shortlist scores, and a global scan for questions whose shortlist gives fewer than ``enough``."""
    first = rerank(shortlist, vectors, queries, k).withColumn("tier", F.lit("shortlist"))
    poor = queries.join(first.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, enough)), "qid", "left_anti")
    second = cosine_top_k(vectors, poor, k).withColumn("tier", F.lit("global"))
    poor_first = first.join(second.select("qid").distinct(), "qid", "left_anti")
    return poor_first.select("qid", "id", "sim", "rank", "tier").unionByName(second.select("qid", "id", "sim", "rank", "tier"))


def decayed_shortlist(anchors: DataFrame, support: DataFrame, base: float = 0.92, item_decay: float = 0.03, anchor_decay: float = 0.02, per_anchor: int = 12, most: int = 256) -> DataFrame:
    """Units supported by ranked entities: base - decays by rank, the best over entities, at least 0."""
    keys = ["qid", "token"] if "qid" in support.columns else ["token"]
    joined = anchors.select("qid", "token", (F.col("rank") - 1).alias("e")).join(support.filter(F.col("rank") < per_anchor).select(*keys, "unit", F.col("rank").alias("c")), keys)
    score = F.greatest(F.lit(0.0), F.lit(base) - item_decay * F.col("c") - anchor_decay * F.col("e"))
    merged = joined.groupBy("qid", "unit").agg(F.round(F.max(score), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "unit")).cast("long")
    return merged.withColumn("rank", rank).filter(F.col("rank") <= most)


def lookup(strategy: str, cached: DataFrame, scanned: DataFrame, wanted: int, enough: float = 0.8) -> DataFrame:
    """Scores of one lookup strategy: ``full`` scans, ``cache_only`` takes what caches give, ``two_tier`` scans for questions
    with fewer than ``wanted`` cached rows, ``adaptive`` for those with less than the share ``enough`` of them.

    cached, scanned: qid, node, score; where both have a node the larger score stays.
    """
    if strategy == "full":
        chosen = scanned
    elif strategy == "cache_only":
        chosen = cached
    else:
        least = wanted if strategy == "two_tier" else enough * wanted
        full = cached.groupBy("qid").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least).select("qid")
        chosen = cached.select("qid", "node", "score").union(scanned.join(full, "qid", "left_anti").select("qid", "node", "score"))
    best = chosen.groupBy("qid", "node").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "node"))
    return best.withColumn("place", place).filter(F.col("place") <= wanted).select("qid", F.col("place").cast("long").alias("rank"), "node", "score")


def expand_support(entities: DataFrame, support: DataFrame, scale: float = 0.85, decay: float = 0.03, most: int = 4) -> DataFrame:
    """Entity scores carried to the first chunks that support them: score x (.85 - .03 rank), the best over entities.

    entities: qid, token, score; support: qid, token, unit, rank (from 0).
    """
    joined = entities.select("qid", "token", "score").join(support.filter(F.col("rank") < most), ["qid", "token"])
    return joined.groupBy("qid", "unit").agg(T.settled(F.max(F.col("score") * (scale - decay * F.col("rank")))).alias("score"))


def signature(rows: DataFrame, ident: str) -> DataFrame:
    """One row: the number of rows and a fingerprint of their ids that does not depend on their order."""
    part = F.conv(F.substring(F.sha1(F.col(ident).cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(ident).alias("n"), F.sum(part).cast("string").alias("fingerprint"))


def cache_boost(entities: DataFrame, support: DataFrame, chunk_scale: float = 0.92, chunk_decay: float = 0.03, entity_scale: float = 0.96, entity_decay: float = 0.02) -> DataFrame:
    """Chunk scores from entity scores by rank decay: entity x (.92 - .03 r) x (.96 - .02 e), the best over entities."""
    keys = ["qid", "token"] if "qid" in support.columns else ["token"]
    joined = entities.select("qid", "token", "sim", (F.col("rank") - 1).alias("e")).join(support.select(*keys, "unit", F.col("rank").alias("r")), keys)
    score = F.col("sim") * F.greatest(F.lit(0.0), chunk_scale - chunk_decay * F.col("r")) * F.greatest(F.lit(0.0), entity_scale - entity_decay * F.col("e"))
    return joined.groupBy("qid", "unit").agg(T.settled(F.max(score)).alias("score"))


def fuse(rows: DataFrame, weight: float = 0.35, head: int = 80) -> DataFrame:
    """(qid, pos, base, sim): the first ``head`` re-ordered by (1 - w) base + w similarity, each to 0..1; the rest stays behind."""
    w = min(max(weight, 0.0), 1.0)
    top = rows.filter(F.col("pos") < head)
    fused = top.withColumn("fused", T.rounded((1 - w) * T.min_max_list(F.col("base"), "qid") + w * T.min_max_list(F.col("sim"), "qid"), 9))
    both = fused.unionByName(rows.filter(F.col("pos") >= head).withColumn("fused", F.lit(None).cast("double")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("fused").desc_nulls_last(), F.when(F.col("fused").isNotNull(), -F.col("sim")), "pos")).cast("long")
    return both.withColumn("rank", rank)
