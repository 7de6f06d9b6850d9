"""Whitening of vectors by a tiled covariance.

Distinct vectors are cut into row blocks and these into column blocks of
``tile`` dimensions. Column blocks are shuffled by their row block; where a row
block's columns meet, every pair of dimension tiles is multiplied, and the
products are summed per tile: first inside each task, then over tasks, one
group for each pair of tiles. The driver assembles the tiles, dims x dims
doubles whatever the number of rows, and decomposes them. A last pass projects
every row.

Defined cases: rows whose vector is null or holds null or non-finite entries
are left out, as is an entry whose floor does not fit 2**53 (an error says so);
shorter vectors count as filled up with zeros; repeated rows and equal vectors
are written as often as they occur but fitted once; a null id stays; other
columns are ignored; a component without variance has ``whitened`` and
``explained`` zero and no part in ``identity_error``; without rows there is no
result; a deviation beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least share of the trace that counts as variance.
NOISE = 1e-14


@dataclass(frozen=True)
class Whitening:
    """tile: dimensions of a column block; rows: vectors of a row block; components: how many are written; scale: units of the integers."""

    tile: int = 32
    rows: int = 4096
    components: int = 4
    scale: float = 256.0


@dataclass
class Fit:
    """What is known of the fit list. ``axes``: unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    covariance: np.ndarray
    identity_error: float = 0.0

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))

    def projection(self, k: int) -> np.ndarray:
        """Columns that turn a centred vector into whitened components; zeros where there is no variance."""
        e = self.values[:k]
        open_ = e > NOISE * max(self.trace, 1e-300)
        return np.where(open_, self.axes[:, :k] / np.sqrt(np.where(open_, e, 1.0)), 0.0)


def quantized(vectors: DataFrame, scale: float, key: str, column: str) -> tuple[DataFrame, int]:
    """``vec_id`` and floor(scale * x) as packed longs, of the rows that take part; and the number of dimensions."""
    slim = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    dims = int(slim.agg(F.max(F.size("vector"))).first()[0] or 0)
    if dims < 1:
        return slim.sparkSession.createDataFrame([], "vec_id long, x binary"), 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vector")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().cast(pa.float64())
            c = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), lengths)
            good = ~lists.is_null().to_numpy(zero_copy_only=False)
            good[row[~np.isfinite(c)]] = False
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * c)
            if (np.abs(x[good[row]]) > 2**53).any():
                raise ValueError("an entry is too large for an exact integer")
            m = np.zeros((b.num_rows, dims), np.int64)
            place = np.arange(len(c)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            m[row, place] = np.where(good[row], x, 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(good)), pa.array([r.tobytes() for r in m[good]], pa.binary())], names=["vec_id", "x"])

    return slim.mapInArrow(run, "vec_id long, x binary"), dims


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


def totals(distinct: DataFrame, dims: int, tile: int) -> tuple[int, np.ndarray]:
    """Rows, and exact sums of each dimension: one row a task and column block, added up per block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * dims
        for b in batches:
            m = _matrix(b.column("x"), dims)
            if len(m) * int(np.abs(m).max(initial=0)) < 1 << 62:
                part = m.sum(0).tolist()
            else:
                part = [sum(map(int, col)) for col in m.T]
            n, s = n + len(m), [a + int(p) for a, p in zip(s, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(v) for v in s])], names=["d", "n", "s"])

    parts = distinct.mapInArrow(run, "d int, n long, s string")
    rows = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = np.zeros(dims, object)
    for r in rows:
        sums[r["d"]] = int(r["s"])
    return (int(rows[0]["n"]) if rows else 0), sums


def centred(m: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly; as longs where they fit, else as Python's integers."""
    most = n * int(np.abs(m).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if most < 1 << 62:
        return m * np.int64(n) - sums.astype(np.int64)
    return m.astype(object) * n - sums


def blocks(distinct: DataFrame, dims: int, w: Whitening) -> DataFrame:
    """Row blocks cut into column blocks: block long, tile int, data binary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        serial, held, size = (task.partitionId() if task else 0) << 32, [], 0

        def cut(m: np.ndarray, at: int) -> pa.RecordBatch:
            starts = range(0, dims, w.tile)
            return pa.RecordBatch.from_arrays([pa.array([at] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()), pa.array([np.ascontiguousarray(m[:, a : a + w.tile]).tobytes() for a in starts], pa.binary())], names=["block", "tile", "data"])

        for b in batches:
            held.append(_matrix(b.column("x"), dims))
            size += b.num_rows
            while size >= w.rows:
                m = np.concatenate(held)
                yield cut(m[: w.rows], serial)
                held, size, serial = [m[w.rows :]], size - w.rows, serial + 1
        if size:
            yield cut(np.concatenate(held), serial)

    return distinct.select("x").mapInArrow(run, "block long, tile int, data binary")


def tile_sums(cut: DataFrame, dims: int, n: int, sums: np.ndarray, w: Whitening) -> np.ndarray:
    """The covariance: products of the tile pairs of each row block, summed per pair of tiles."""
    starts = list(range(0, dims, w.tile))
    pairs = list(combinations_with_replacement(range(len(starts)), 2))
    schema = "i int, j int, product binary"

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        block, columns = None, {}

        def close() -> None:
            for i, j in pairs:
                if i in columns and j in columns:
                    product = columns[i].T @ columns[j]
                    if (i, j) in total:
                        total[i, j] += product
                    else:
                        total[i, j] = product

        for b in batches:
            for at, tile, data in zip(b.column("block").to_pylist(), b.column("tile").to_pylist(), b.column("data").to_pylist(), strict=True):
                if at != block:
                    close()
                    block, columns = at, {}
                lo = starts[tile]
                width = min(w.tile, dims - lo)
                m = np.frombuffer(data, np.int64).reshape(-1, width)
                columns[tile] = centred(m, n, sums[lo : lo + width]).astype(np.float64) / n
        close()
        for (i, j), product in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([product.tobytes()], pa.binary())], names=["i", "j", "product"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, product in zip(b.column("i").to_pylist(), b.column("j").to_pylist(), b.column("product").to_pylist(), strict=True):
                x = np.frombuffer(product)
                total[i, j] = total[i, j] + x if (i, j) in total else x
        for (i, j), product in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([product.tobytes()], pa.binary())], names=["i", "j", "product"])

    width = common.width(cut.sparkSession)
    met = cut.repartition(width, "block").sortWithinPartitions("block", "tile")
    rows = met.mapInArrow(multiply, schema).repartition(min(width, len(pairs)), "i", "j").mapInArrow(add, schema).collect()  # dims x dims in all
    out = np.zeros((dims, dims))
    for r in rows:
        a, b = starts[r["i"]], starts[r["j"]]
        x = np.frombuffer(bytes(r["product"])).reshape(min(w.tile, dims - a), -1) / n
        out[a : a + x.shape[0], b : b + x.shape[1]] = x
        out[b : b + x.shape[1], a : a + x.shape[0]] = x.T
    return out


def _moments(distinct: DataFrame, dims: int, fit: Fit, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and mean products of the whitened components over the fit list."""
    turn, n, sums = fit.projection(k), fit.n, fit.sums

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y = (centred(_matrix(b.column("x"), dims), n, sums).astype(np.float64) / n) @ turn
            one, two = one + y.sum(0), two + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([one, two.ravel()]))], names=["e", "v"])

    found = {r["e"]: r["v"] for r in distinct.mapInArrow(run, "e int, v double").groupBy("e").agg(F.sum("v").alias("v")).collect()}
    flat = np.asarray([found.get(i, 0.0) for i in range(k + k * k)]) / n
    return flat[:k], flat[k:].reshape(k, k)


def fit(table: DataFrame, dims: int, w: Whitening = Whitening()) -> Fit | None:
    """Fit on each distinct vector once."""
    distinct = common.durable(table.select("x").distinct())
    n, sums = totals(distinct, dims, w.tile)
    if not n:
        return None
    covariance = tile_sums(blocks(distinct, dims, w), dims, n, sums, w)
    values, axes = np.linalg.eigh(covariance)
    out = Fit(n, sums, values[::-1].copy(), axes[:, ::-1].copy(), covariance)
    k = min(w.components, dims)
    mean, square = _moments(distinct, dims, out, k)
    open_ = np.flatnonzero(out.projection(k).any(0))
    error = (square - np.outer(mean, mean) - np.eye(k))[np.ix_(open_, open_)]
    out.identity_error = float(np.abs(error).max(initial=0.0))
    return out


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, w: Whitening = Whitening(), key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Whitened components of every row that takes part, one row for each of the first ``components``."""
    table, dims = quantized(vectors, w.scale, key, column)
    found = fit(table, dims, w) if dims else None
    if found is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    k = min(w.components, dims)
    turn, n, sums, error = found.projection(k), found.n, found.sums, found.identity_error
    explained = np.where(turn.any(0), found.values[:k] / max(found.trace, 1e-300), 0.0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away = centred(_matrix(b.column("x"), dims), n, sums)
            if len(away) and away.dtype != object and float(np.abs(away).max()) ** 2 * dims >= 2**62:
                away = away.astype(object)
            deviation = (away * away).sum(1)
            if len(away) and max(deviation.tolist()) >= 1 << 63:
                raise OverflowError("a deviation does not fit a long")
            y = (away.astype(np.float64) / n) @ turn
            rows = len(away)
            arrays = [b.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n)), pa.array(np.repeat(deviation.astype(np.int64), k)), pa.array(y.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return table.mapInArrow(run, SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.read(spark, sf_dir, "embeddings"))
