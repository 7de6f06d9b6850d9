"""Counts of the whole corpus, looked up for every text without a hot key.

Keys that occur often are few: those of at least a certain count, chosen so
that there are no more than a stated number of them, go to every task as sorted
arrays. The others are rare by the same token, so what refers to them is
shuffled to their counts without any key that holds many rows. A pass over the
texts writes one row a text, with its own sums over frequent keys and a packed
list of its rare ones; ``resolved`` adds up what the counts say of these.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries that a task counts before it hands them on.
HELD = 1 << 20
COUNTED = "h1 long, h2 long, n long"
_NAMES = [c.split()[0] for c in COUNTED.split(", ")]


class Counter:
    """Counts of 128-bit keys in one task: entries gather until there are many, then equal ones are joined."""

    def __init__(self, most: int = HELD):
        self.most, self.held, self.size = most, [], 0

    def add(self, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((h1, h2, n))
        self.size += len(h1)
        if self.size > 2 * self.most:
            self._join()
            if self.size > self.most:
                yield from self.flush()

    def _join(self) -> None:
        h1, h2, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(h1, kind="stable")
        h1, h2, n = h1[order], h2[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else np.zeros(0, np.int64)
        self.held = [(h1[first], h2[first], np.add.reduceat(n, first) if len(first) else n)]
        self.size = len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._join()
            h1, h2, n = self.held[0]
            for i in range(0, len(h1), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(h1[part].view(np.int64)), pa.array(h2[part].view(np.int64)), pa.array(n[part].astype(np.int64))], names=_NAMES)
        self.held, self.size = [], 0


def summed(parts: DataFrame) -> DataFrame:
    """One row a key: h1, h2, n."""
    return common.durable(parts.groupBy("h1", "h2").agg(F.sum("n").alias("n")))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The keys of the largest counts, ``most`` at most: all those from a certain count on, by a histogram of counts."""
    cell = F.floor(64 * F.log2(F.col("n").cast("double")))
    cells = sorted(((r["cell"], r["k"]) for r in counts.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # 64 cells for each doubling
    least, total = None, 0
    for at, k in cells:
        total += k
        if total > most:
            break
        least = at
    return counts.filter(cell >= least) if least is not None else counts.limit(0)


class Table:
    """Sorted distinct 64-bit keys, spread evenly, and where they are."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(4 * len(keys) + 1).bit_length())
        ends = (np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) - np.uint64(1)
        self.first = np.concatenate([[0], np.searchsorted(keys, ends, "right")]).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at, todo = self.first[(keys >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64), np.arange(len(keys))
        while len(todo):
            inside = at < len(self.keys)
            at, todo = at[inside], todo[inside]
            have, want = self.keys[at], keys[todo]
            out[todo[have == want]] = at[have == want]
            on = have < want
            at, todo = at[on] + 1, todo[on]
        return out


ROW = "r long, rare binary"


class Rows:
    """Numbers of the rows that a task writes, unique over the tasks of a stage."""

    def __init__(self):
        task = TaskContext.get()
        self.next = (task.partitionId() if task else 0) << 40

    def take(self, n: int) -> np.ndarray:
        self.next += n
        return np.arange(self.next - n, self.next)


#: One rare key of a text and how often it occurs there.
RARE = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("m", "<i4")])


def packed(h1: np.ndarray, h2: np.ndarray, m: np.ndarray) -> bytes:
    out = np.empty(len(h1), RARE)
    out["h1"], out["h2"], out["m"] = h1.view(np.int64), h2.view(np.int64), m
    return out.tobytes()


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = b.column("rare").to_pylist()
        rows = b.column("r").to_numpy()
        lo, size = 0, 0
        for i, x in enumerate(raw):
            size += len(x)
            if size > 1 << 22 or i == len(raw) - 1:
                sizes = [len(x) // RARE.itemsize for x in raw[lo : i + 1]]
                found = np.frombuffer(b"".join(raw[lo : i + 1]), RARE)
                for k in range(0, len(found), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows[lo : i + 1], sizes)[part]), *(pa.array(np.ascontiguousarray(found[c][part])) for c in ("h1", "h2", "m"))], names=["r", "h1", "h2", "m"])
                lo, size = i + 1, 0


def resolved(rows: DataFrame, counts: DataFrame, **sums: Column) -> DataFrame:
    """``rows`` (cut, with r and rare) and, of each, sums over its rare keys. In ``sums``, n is the key's count
    (zero if nobody counted it) and m how often the row has it."""
    keys = rows.filter(F.length("rare") > 0).select("r", "rare").mapInArrow(_unpack, "r long, h1 long, h2 long, m int")
    found = keys.join(counts.hint("shuffle_hash"), ["h1", "h2"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    each = found.groupBy("r").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    return rows.drop("rare").join(each, "r", "left").drop("r")
