"""Exact top-k inner products: norm-sorted blocks with rotated partial sums.

Vectors are turned to integers and sorted by descending length into blocks. An
orthogonal rotation by the eigenvectors of their Gram matrix (the right
singular vectors of all of them) moves most of every vector into its first
coordinates. Queries are cut into blocks too and meet the blocks of vectors in
tiers: the longest block first, then each time eight times as many, shorter
ones. A tier starts from the thresholds that the tiers before have left. Pairs
of blocks whose longest vectors cannot reach any threshold are dropped before
their vectors are joined; within a task a query's threshold rises with every
block it meets. Then partial sums over the leading coordinates plus the
Cauchy-Schwarz bound of the rest drop most vectors, and only what is left is
scored, exactly, in integers.

A row of the shuffle is a packed block, so the stated queries meet all vectors
in pairs of blocks and no pair of rows is ever written out.

Defined cases: rows with a null id, a null vector, or a null or non-finite
component take no part; shorter vectors count as filled up with zeros; a
repeated row is a candidate as often as it occurs; of repeated queries with
one id the smallest vector asks; scores beyond a long are cut to its range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
#: Vectors and queries of a packed block; coordinates of the partial sums.
BLOCK, QUERIES, HEAD = 8192, 1024, 16
#: Blocks of a tier for each one of the tier before.
TIER = 8
#: Query blocks whose thresholds a task remembers.
KNOWN = 256
FOUND = "q_block long, query_id long, vec_id long, score long"
BLOCKED = "block long, top double, n int, ids binary, vectors binary"


def quantized(vectors: DataFrame, scale: float, key: str, column: str) -> DataFrame:
    """``vec_id``, squared length, number of components, and floor(scale * x) packed as doubles."""
    schema = "vec_id long, norm2 double, dims int, v binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("vec_id").to_pylist()
            lists = b.column("vector")
            rows = []
            lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.float64())
            holes = flat.is_null().to_numpy(zero_copy_only=False)
            values = np.floor(scale * flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
            ends = np.cumsum(np.maximum(lengths, 0))
            bad = holes | ~np.isfinite(values)
            for i, (n, e) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
                if n < 0 or ids[i] is None or bad[e - n : e].any():
                    continue
                v = values[e - n : e]
                with np.errstate(over="ignore"):
                    rows.append((ids[i], float(v @ v), n, v.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "norm2", "dims", "v"])

    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("vector")).mapInArrow(run, schema)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    raw = column.to_pylist()
    if all(len(r) == 8 * dims for r in raw):
        return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dims)
    out = np.zeros((len(raw), dims))
    for row, r in zip(out, raw, strict=True):
        row[: len(r) // 8] = np.frombuffer(r, np.float64)
    return out


def gram(table: DataFrame, dims: int) -> np.ndarray:
    """Sum of outer products over all vectors, in two levels: at most 64 matrices reach the driver."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((dims, dims)), 0
        for b in batches:
            m = _matrix(b.column("v"), dims)
            total += m.T @ m
            some = b.num_rows and int(b.column("vec_id")[0].as_py())
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([some % 64], pa.int32()), pa.array([total.tobytes()])], names=["slot", "m"])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(m.as_py()) for b in batches for m in b.column("m")), np.zeros(dims * dims))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])

    parts = table.select("vec_id", "v").mapInArrow(part, "slot int, m binary")
    rows = parts.repartition(64, "slot").mapInArrow(summed, "m binary").collect()
    return sum((np.frombuffer(bytes(r["m"])) for r in rows), np.zeros(dims * dims)).reshape(dims, dims)


def rotation(g: np.ndarray) -> np.ndarray:
    """Orthogonal columns, the direction of the most length first."""
    if not np.isfinite(g).all():
        return np.eye(len(g))
    return np.linalg.eigh(g)[1][:, ::-1].copy()


def packed(table: DataFrame, dims: int, size: int, parts: int) -> DataFrame:
    """Blocks of vectors by descending length; ``top`` is a block's largest length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, serial, pid = 0, 0, 0

        def block(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            m = _matrix(t.column("v"), dims)
            return pa.RecordBatch.from_arrays([pa.array([(pid << 32) + serial], pa.int64()), pa.array([float(np.sqrt(t.column("norm2")[0].as_py()))]), pa.array([t.num_rows], pa.int32()), pa.array([t.column("vec_id").to_numpy().tobytes()]), pa.array([m.tobytes()])], names=["block", "top", "n", "ids", "vectors"])

        for b in batches:
            if b.num_rows:
                pid = b.column("pid")[0].as_py()
                held.append(b)
                count += b.num_rows
            while count >= size:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, size))
                held, count, serial = t.slice(size).to_batches(), count - size, serial + 1
        if count:
            yield block(pa.Table.from_batches(held))

    dealt = table.repartitionByRange(parts, F.col("norm2").desc(), "vec_id").sortWithinPartitions(F.col("norm2").desc(), "vec_id")
    return dealt.withColumn("pid", F.spark_partition_id()).select("pid", "vec_id", "norm2", "v").mapInArrow(run, BLOCKED)


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of two matrices of whole doubles."""
    most = (np.abs(q).max(initial=0.0)) * (np.abs(v).max(initial=0.0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = np.asarray([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.asarray([[int(x) for x in r] for r in v], object).reshape(v.shape).T
    info = np.iinfo(np.int64)
    return np.asarray([[min(max(x, info.min), info.max) for x in r] for r in whole], np.int64).reshape(len(q), len(v))


class Searcher:
    """Scores a block of vectors for a block of queries."""

    def __init__(self, k: int, turn: np.ndarray):
        self.k, self.turn = k, turn
        self.head = min(HEAD, len(turn))

    def top(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, v: np.ndarray, longest: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query that this block may still improve: ids and scores of its best, ties to smaller ids."""
        lengths = np.sqrt((q * q).sum(1))
        open_ = np.flatnonzero(lengths * longest * (1 + 1e-9) + 1e-6 >= floor)  # else no vector here is long enough
        if not len(open_):
            return
        rq, rv = q[open_] @ self.turn, v @ self.turn
        h = self.head
        rest_q = np.sqrt((rq[:, h:] ** 2).sum(1))
        rest_v = np.sqrt((rv[:, h:] ** 2).sum(1))
        size_v = np.sqrt((v * v).sum(1))
        partial = rq[:, :h] @ rv[:, :h].T
        slack = 1e-9 * lengths[open_][:, None] * size_v[None, :] + 1e-6  # rounding of the rotated sums
        may = partial + rest_q[:, None] * rest_v[None, :] + slack >= floor[open_][:, None]
        for i, row in zip(open_.tolist(), may, strict=True):
            at = np.flatnonzero(row & (ids != qid[i]))
            if not len(at):
                continue
            score = exact(q[i : i + 1], v[at])[0]
            if len(at) > 4 * self.k:
                cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
                keep = score >= cut
                at, score = at[keep], score[keep]
            order = np.lexsort((ids[at], -score))[: self.k]
            yield i, ids[at[order]], score[order]


def raised(floor: np.ndarray, held: np.ndarray, found: list[tuple[int, np.ndarray]]) -> None:
    """Enter new scores into each query's best ones so far, and raise its threshold to the last of them.

    held: best scores of each query in rising order, -inf for none; both are changed in place.
    """
    for i, score in found:
        best = np.sort(np.concatenate([held[i], score]))[-held.shape[1] :]
        held[i] = best
        floor[i] = max(floor[i], best[0])


def _search(pairs: DataFrame, k: int, dims: int, turn: np.ndarray) -> DataFrame:
    """Best k of every pair of blocks that a query's threshold leaves open. ``kths``: thresholds of the tiers before."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Searcher(k, turn)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for row in range(b.num_rows):
                r = {c: b.column(c)[row].as_py() for c in b.schema.names}
                qid, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, v = (np.frombuffer(r[c]).reshape(-1, dims) for c in ("q_vectors", "vectors"))
                if r["q_block"] not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    given = {x["query_id"]: x["kth"] for x in r["kths"] or ()}
                    known[r["q_block"]] = np.asarray([given.get(x, -np.inf) for x in qid.tolist()], float), np.full((len(qid), k), -np.inf)
                floor, held = known[r["q_block"]]
                out = []
                for lo in range(0, len(qid), 128):
                    part = slice(lo, lo + 128)
                    found = list(s.top(qid[part], q[part], floor[part], ids, v, r["top"]))
                    out += [np.stack([np.full(len(at), r["q_block"]), np.full(len(at), qid[lo + i]), at, score]) for i, at, score in found]
                    # scores as doubles may round up: the threshold stays a little below
                    raised(floor, held, [(lo + i, score.astype(float) * (1 - 1e-12 * np.sign(score)) - 1e-6) for i, _, score in found])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, 1)], names=[c.split()[0] for c in FOUND.split(", ")])

    return pairs.select("q_block", "q_ids", "q_vectors", "kths", "top", "ids", "vectors").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def tiers(blocks: int) -> list[tuple[int, int]]:
    """Ranges of blocks in order of their longest vector."""
    out, at, size = [], 0, 1
    while at < blocks:
        out.append((at, min(blocks, at + size)))
        at, size = at + size, size * TIER
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k highest integer inner products of every query with all other rows: ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    table = common.durable(quantized(vectors, scale, key, column))
    asks = quantized(queries, scale, key, column).groupBy("vec_id").agg(F.min(F.struct("v", "norm2")).alias("m")).select("vec_id", "m.v", "m.norm2")
    facts = table.agg(F.max("dims"), F.count(F.lit(1))).first()
    dims, n = max(1, facts[0] or 0), facts[1]
    turn = rotation(gram(table, dims))
    width = common.width(spark)
    parts = max(1, min(width, -(-n // BLOCK)))
    blocks = common.durable(packed(table, dims, BLOCK, parts))
    q = packed(asks, dims, QUERIES, max(1, min(width, -(-n // (50 * QUERIES)))))
    q = common.durable(q.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("top").alias("q_top"), F.col("n").alias("q_n")))
    found = _best(spark.createDataFrame([], FOUND), k).drop("rank")
    above = None
    for lo, hi in tiers(total := blocks.count()):
        tier = blocks if above is None else blocks.filter(F.col("top") < above)
        if hi < total:  # one number for each block tells where the tier ends
            above = blocks.select("top", F.row_number().over(Window.orderBy(F.desc("top"))).alias("r")).filter(F.col("r") == hi).first()["top"]
            tier = tier.filter(F.col("top") >= above)
        # query blocks go to all groups of the tier's vector blocks and meet the blocks there that are long enough
        groups = max(1, min(width, hi - lo))
        asked = q.join(_thresholds(found, k), "q_block", "left").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "group")
        low = F.when(F.col("known") == F.col("q_n"), F.col("low")).otherwise(float("-inf"))
        reach = F.col("q_top") * F.col("top") * (1 + 1e-9) + 1e-6 >= low
        pairs = asked.join(tier.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")), "group").filter(reach)
        found = common.durable(_best(found.union(_search(pairs, k, dims, turn)), k).drop("rank"))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _thresholds(found: DataFrame, k: int) -> DataFrame:
    """Of each block of queries: the k-th best scores known so far, the smallest of them, and how many are known."""
    last = found.groupBy("q_block", "query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").cast("double").alias("kth")).filter(F.col("c") >= k)
    # at most QUERIES entries
    return last.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "kth")).alias("kths"), F.min("kth").alias("low"), F.count(F.lit(1)).alias("known"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))
