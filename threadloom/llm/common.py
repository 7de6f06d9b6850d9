"""Shared plumbing of the corpus operators: tables, durable cuts, hashing of words.

Everything here is either a thin Spark helper or a numpy kernel that works on
one Arrow batch at a time, so memory is bounded by the batch and never by the
table.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes up at a time; one longer text is taken whole.
SLICE_BYTES = 1 << 18


#: Rows of an Arrow batch: texts are long, and the default of 10,000 makes batches of many megabytes on both sides.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession, rows: int = 2000) -> None:
    """Smaller Arrow batches for tables of texts, unless the session has set its own size."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``. Only where none is
    set (tests on one machine) a temporary folder is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint(eager=True)


#: Stored bytes of input for each task of a hand-made shuffle, and the most tasks of one.
TASK_BYTES, MOST_TASKS = 64 << 20, 50_000


def width(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Tasks that a hand-made shuffle deals to: what the session plans for, and more where ``df`` is a scan of so many
    bytes that a task would get over ``TASK_BYTES`` of them."""
    planned = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    if df is None:
        return planned
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 55  # beyond, the planner does not know
    return max(planned, min(MOST_TASKS, -(-size // TASK_BYTES))) if known else planned


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has no more than so many rows, else as it is: joins then shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: What an operator keeps in a Python worker between its tasks, by owner: callables that drop it.
KEPT: dict[str, Callable[[], None]] = {}
_owner = ""


def sole(owner: str) -> None:
    """At the start of a task: workers serve many operators in turn, so drop what others have kept."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    for name, drop in KEPT.items():
        if name != owner:
            drop()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ---------------------------------------------------------------- numpy kernel


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit values: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n pseudo-random 64-bit values made by rule from the salt."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = seeds(256, 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_2 = seeds(256, 2)
#: Values of a span that are mixed in one by one; what follows them is digested whole.
LONG = 48
#: First state, multiplier and shift of the two hashes.
_MIX = [(np.uint64(0x9AE16A3B2F90404F), np.uint64(0xD6E8FEB86659FD93), np.uint64(29)), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F), np.uint64(31))]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False, raw: np.ndarray | None = None) -> np.ndarray:
    """Hash of values[start:end] for each pair; with ``other``, by another function.

    Each value is mixed in by a multiplication and a shift, in order, for all
    spans at once; spans are taken in order of length, so only those that go on
    are touched. Past ``LONG`` values the rest goes through a cryptographic
    digest, of the bytes of ``raw`` if given (one for each value).
    """
    state, factor, shift = _MIX[other]
    size = ends - starts
    short = np.minimum(size, LONG + 1).astype(np.uint8)
    goes_on = len(size) - np.cumsum(np.bincount(short, minlength=LONG + 2))  # [k]: spans of more than k values
    uniform = not len(size) or goes_on[short[0]] == 0 and goes_on[max(int(short[0]) - 1, 0)] == len(size)
    order = slice(None) if uniform else np.argsort(short, kind="stable")[::-1]
    at = starts[order]
    h = np.full(len(size), state, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LONG):
            n = int(goes_on[k])
            if not n:
                break
            x = h[:n]
            x ^= values[at[:n] + k]
            x *= factor
            x ^= x >> shift
        if goes_on[LONG]:
            source, last = values if raw is None else raw, ends[order]
            for i in range(int(goes_on[LONG])):
                digest = hashlib.blake2b(source[int(at[i]) + LONG : int(last[i])].tobytes(), digest_size=8, person=b"b" if other else b"a").digest()
                h[i] ^= np.uint64(int.from_bytes(digest, "little"))
        out = h
        if not uniform:
            out = np.empty_like(h)
            out[order] = h
        return mix64(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of texts, as arrays over their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(self.data)
        solid = ~_SPACE[self.data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = self.offsets[self.offsets < n]
        first[cuts] = solid[cuts]
        cuts = self.offsets[self.offsets > 0] - 1
        last[cuts] = solid[cuts]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        #: of each text: index of its first word; one more at the end
        self.bounds = np.searchsorted(self.starts, self.offsets, "left")

    def hashes(self, other: bool = False) -> np.ndarray:
        """A hash of each word; with ``other``, one that is independent of the first."""
        return span_hash((_BYTE_2 if other else _BYTE)[self.data], self.starts, self.ends, other, self.data)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of the k-word windows inside one text, and their hashes."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, span_hash(hashes, at, at + k)


def batches_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffers(batch.column(column))
    for i, j in slices(offsets):
        yield i, j, Words(data, offsets[i : j + 1])


def per_text(words: Words, marked: np.ndarray) -> np.ndarray:
    """Sum of a value per word over each text."""
    sums = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=sums[1:])
    return sums[words.bounds[1:]] - sums[words.bounds[:-1]]
