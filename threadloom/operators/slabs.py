"""Personalized PageRank of many walkers over one large graph with two sides, such as units and the entities that they name.

The graph is packed into slabs: units with all their links, some million
edges each. A few walkers at a time go through all slabs in one task,
a column each, and only the masses of the links' side are carried from one step
to the next; so nothing is shuffled between steps, and a task holds no more
than these masses, the packed edges (in a file of its own where they are many) and one slab's sums.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from .diffusion import RESTART, cut

#: Longest run of rows that is added up at a time; longer lists are made of several.
RUN = 64
JOINED = "spark.sql.unionOutputPartitioning"


def packed(names: pa.Array | pa.ChunkedArray) -> bytes:
    batch = pa.record_batch([names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names], ["name"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(blob).read_all()["name"].combine_chunks()


def slabs(units: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A graph's units in slabs of about ``most`` edges: units and links (names, packed), sizes and ids (packed integers).

    units: node, linked (names, each once); each node once, none null. Units without links are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, pa.Array]] = []

        def slab() -> pa.RecordBatch:
            links = pa.chunked_array([x[2] for x in held]).combine_chunks().dictionary_encode()
            row = packed(pa.chunked_array([x[0] for x in held])), packed(links.dictionary), np.concatenate([x[1] for x in held]).astype(np.int32).tobytes(), links.indices.to_numpy().astype(np.int32).tobytes()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["units", "links", "sizes", "ids"])

        n = 0
        for b in batches:
            for part in (b.slice(i, 2_000) for i in range(0, b.num_rows, 2_000)):
                nodes, lists = part.columns
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                kept = np.flatnonzero(sizes > 0)
                if len(kept):
                    held.append((nodes.take(pa.array(kept)), sizes[kept], lists.take(pa.array(kept)).flatten()))
                    n += int(sizes[kept].sum())
                if n >= most:
                    yield slab()
                    n = 0
        if held:
            yield slab()

    return units.select("node", F.col("linked").cast("array<string>").alias("linked")).mapInArrow(work, StructType([StructField(c, BinaryType()) for c in ("units", "links", "sizes", "ids")]))


def linked_nodes(graph: DataFrame) -> DataFrame:
    """Names of the links' side, some of them more than once: node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("links"):
                yield pa.RecordBatch.from_arrays([unpacked(blob.as_py())], ["node"])

    return graph.select("links").mapInArrow(work, "node string")


class Lists:
    """Lists of rows to be added up, cut in runs of equal length: for each length the lists and a matrix of rows, one column a run."""

    def __init__(self, sizes: np.ndarray, rows: np.ndarray, hold):
        starts, full, rest = np.cumsum(sizes) - sizes, sizes // RUN, sizes % RUN
        self.n, self.runs = len(sizes), []
        for length in (RUN, *np.unique(rest[rest > 0])):
            if length == RUN:
                own = np.repeat(np.arange(self.n), full)
                at = starts[own] + RUN * (np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full))
            else:
                own = np.flatnonzero(rest == length)
                at = starts[own] + RUN * full[own]
            if len(own):
                self.runs.append((hold(own.astype(np.int32)), hold(np.stack([rows[at + j] for j in range(length)]).astype(np.int32))))

    def sums(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]))
        for own, rows in self.runs:
            total, more = np.empty((2, len(own), x.shape[1]))
            np.take(x, rows[0], 0, total, "clip")
            for r in rows[1:]:
                np.take(x, r, 0, more, "clip")
                np.add(total, more, total)
            if len(rows) == RUN:  # runs of one list lie together
                first = np.flatnonzero(np.diff(own.astype(np.int64), prepend=-1))
                out[own[first]] += np.add.reduceat(total, first, axis=0)
            else:
                out[own] += total
        return out


class Held:
    """Arrays in memory, and in a file of the task's own once they are many."""

    def __init__(self, room: int):
        self.room, self.file = room, None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        self.room -= x.nbytes
        if self.room >= 0:
            return x
        self.file = self.file or tempfile.TemporaryFile()
        at = -(-self.file.seek(0, 2) // 64) * 64
        self.file.seek(at)
        self.file.write(x.tobytes())
        self.file.flush()
        return np.memmap(self.file, x.dtype, "r", at, x.shape)


class Slab:
    """One slab in a task: places of its links among all, and the lists of both sides."""

    def __init__(self, units: pa.Array, at: np.ndarray, sizes: np.ndarray, ids: np.ndarray, hold):
        self.units, self.at, self.sizes = units, at, sizes
        # by both halves of the number: numbers of 16 bits are sorted in linear time
        order = np.argsort((ids & 0xFFFF).astype(np.uint16), kind="stable")
        order = order[np.argsort((ids >> 16).astype(np.uint16)[order], kind="stable")]
        self.ends = np.bincount(ids, minlength=len(at))
        self.of_units = Lists(sizes, ids, hold)
        self.of_links = Lists(self.ends, np.repeat(np.arange(len(sizes)), sizes)[order], hold)


def solve(graph: list[Slab], ends: np.ndarray, start: np.ndarray, alpha: float, tolerance: float, rounds: int) -> np.ndarray:
    """Masses of the links' side by neighbour, a column a walker, by conjugate gradients; ``start`` is used up.

    Over nodes weighed by 1 / neighbours the step is symmetric, with values from 0 to b^2, b = 1 - alpha; so a residual of norm t
    leaves an error of at most t / (1 - b^2) * sqrt(neighbours of u) at u, and each column goes on until that is within the tolerance.
    """
    b, root = 1 - alpha, np.sqrt(ends)[:, None]
    largest = max(ends.max(), b * b * max(s.sizes.max() for s in graph))
    goal = tolerance * (1 - b * b) / math.sqrt(largest)
    dot = lambda x, y: np.einsum("ij,ij->j", x, y)
    r = start
    r *= alpha / root
    u, p, x, moved = np.zeros_like(r), r.copy(), np.empty_like(r), np.empty_like(r)
    norm = dot(r, r)
    for _ in range(rounds):
        if np.sqrt(norm.max()) <= goal:
            u /= root
            return u
        np.divide(p, root, x)
        moved[:] = 0.0
        for s in graph:
            held = s.of_units.sums(x[s.at])
            held /= s.sizes[:, None]
            moved[s.at] += s.of_links.sums(held)
        moved *= -b * b / root
        moved += p
        share = norm / np.maximum(dot(p, moved), np.finfo(float).tiny)
        share[np.sqrt(norm) <= goal] = 0.0
        u += np.multiply(share, p, x)
        r -= np.multiply(share, moved, x)
        before, norm = norm, dot(r, r)
        p *= np.where(before > 0, norm / np.where(before > 0, before, 1.0), 0.0)
        p += r
    raise RuntimeError(f"walkers are left after {rounds} rounds; raise rounds or the tolerance")


def least(values: np.ndarray, most: int | None, digits: int) -> float:
    """The least value that, settled to ``digits``, equals the ``most``-th largest; 0 where there are fewer or it is as good as none."""
    if most is None or len(values) < most:
        return 0.0
    scale, hair = 10.0**digits, 10.0 ** -(digits + 3)
    kth = np.partition(values, len(values) - most)[len(values) - most]
    return max(0.0, (math.floor((kth + hair) * scale + 0.5) - 0.5) / scale - 1.01 * hair)


def walk(
    graph: DataFrame, restart: DataFrame, most: int | None = None, digits: int = 4, tolerance: float = 2e-5, alpha: float = RESTART, rounds: int = 400, room: int = 1 << 29
) -> DataFrame:
    """Personalized PageRank of walkers that start on the links' side: qid, node, mass, each within ``tolerance``.

    graph: of ``slabs``; restart: qid, node, mass (nodes that no unit links to
    are left out, a walker without nodes has no rows). A walker's rows are the
    nodes that it has reached; with ``most`` those that, settled to ``digits``,
    are no less than its ``most``-th, so ties at the end are all there.
    """
    spark = graph.sparkSession
    ids = restart.select("qid").distinct()
    n = ids.count()
    kind = restart.schema["qid"].dataType
    schema = StructType([StructField("qid", kind), StructField("node", StringType()), StructField("mass", DoubleType())])
    if not n:
        return restart.select("qid", F.col("node").cast("string").alias("node"), F.col("mass").cast("double").alias("mass"))
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n // 8)))
    # numbered apart, so no task numbers all walkers
    place = F.row_number().over(Window.partitionBy("shelf").orderBy("qid"))
    seats = ids.withColumn("shelf", F.pmod(F.xxhash64("qid"), F.lit(-(-n // 4096)))).select("qid", F.pmod(place, F.lit(tasks)).alias("task"))
    starts = cut(restart.groupBy("qid", "node").agg(F.sum("mass").alias("mass")).join(seats, "qid"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("units", "links", "sizes", "ids")]
    bare = [F.lit(None).cast(restart.schema[c].dataType if c == "qid" else t).alias(c) for c, t in (("qid", ""), ("node", "string"), ("mass", "double"))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, units, links, lists = [], [], [], []
        for b in batches:
            rows = b.filter(pa.compute.is_valid(b.column("qid")))
            asked.append(rows.select(["qid", "node", "mass"]))
            for u, k, size, i in zip(*(b.column(c) for c in ("units", "links", "sizes", "ids")), strict=True):
                if u.is_valid:
                    units.append(unpacked(u.as_py()))
                    links.append(unpacked(k.as_py()))
                    lists.append((np.frombuffer(size.as_py(), np.int32), np.frombuffer(i.as_py(), np.int32)))
        asked = pa.Table.from_batches(asked) if asked else None
        if not links or not asked.num_rows:
            return
        whole = pa.chunked_array(links).dictionary_encode().unify_dictionaries()
        names = whole.chunk(whole.num_chunks - 1).dictionary
        hold, parts, ends = Held(room), [], np.zeros(len(names), np.int64)
        links.clear()
        for k, (u, at) in enumerate(zip(units, whole.chunks, strict=True)):
            parts.append(Slab(u, at.indices.to_numpy(), *lists[k], hold))
            lists[k] = None
            ends[parts[-1].at] += parts[-1].ends
        spot = pa.compute.index_in(asked["node"], names).to_numpy()
        inside = ~np.isnan(spot.astype(float))
        spot, mass, seat = spot[inside].astype(np.int64), asked["mass"].to_numpy()[inside], asked["qid"].combine_chunks().dictionary_encode()
        seat, qids = seat.indices.to_numpy()[inside], seat.dictionary
        found = np.unique(seat)
        width = min(16, max(1, room // (48 * len(names))))
        for some in np.array_split(found, -(-len(found) // width)) if len(found) else ():
            mine = np.isin(seat, some)
            start = np.zeros((len(names), len(some)))
            np.add.at(start, (spot[mine], np.searchsorted(some, seat[mine])), mass[mine])
            x = solve(parts, ends, start, alpha, tolerance, rounds)
            # links first: they hold the hubs, so few units are kept besides
            kept: list[list] = [[] for _ in some]
            edge = [0.0] * len(some)
            for piece in (None, *parts):
                value = x * ends[:, None] if piece is None else (1 - alpha) * piece.of_units.sums(x[piece.at])
                for j in range(len(some)):
                    near = np.flatnonzero((value[:, j] >= edge[j]) & (value[:, j] != 0))
                    if len(near):
                        kept[j].append(((names if piece is None else piece.units).take(pa.array(near)), np.maximum(value[near, j], 0.0)))
                        edge[j] = max(edge[j], least(kept[j][-1][1], most, digits))
            for j, s in enumerate(some):
                value = np.concatenate([v for _, v in kept[j]])
                node = pa.chunked_array([c for c, _ in kept[j]]).combine_chunks()
                near = np.flatnonzero(value >= least(value, most, digits))
                for i in range(0, len(near), 100_000):
                    at = near[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([qids[s].as_py()] * len(at), qids.type), node.take(pa.array(at)), pa.array(value[at])], ["qid", "node", "mass"])

    sides = [starts.filter(F.col("task") == t).select("qid", "node", "mass", *none).union(graph.select(*bare, "units", "links", "sizes", "ids")).coalesce(1).mapInArrow(work, schema) for t in range(tasks)]
    together = spark.conf.get(JOINED, "true")
    spark.conf.set(JOINED, "false")  # else Spark joins parts that are one partition each into one task
    try:
        return cut(reduce(DataFrame.union, sides))
    finally:
        spark.conf.set(JOINED, together)
