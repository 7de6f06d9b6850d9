"""Substring dedup by level-wise doubling of repeated word windows.

Level one looks at windows of half the length; windows that repeat at that
length alone are extended to twice the length, where repeats are decided. A
window of the full length holds ``half + 1`` half windows; the one with the
smallest hash stands for it, the same one wherever the passage occurs, so the
first level needs only about two half windows in ``half + 2`` and still misses
no repeat. Full windows whose stand-in occurs once have no candidates and are
never looked at again. At the second level each full window that is left is
held against all others, by 128 bits of hash; every occurrence but the first is
covered. ``longest_repeats`` goes on from there: windows of twice the length
whose two halves repeat, again and again, until no candidates survive.

Positions travel as packed arrays dealt by hash. Occurrences that repeat
inside one batch or group are settled there and only its first goes on, so a
passage that a third of all documents share costs one entry per batch. Texts
are shuffled once, by id, and that shuffle serves both passes over them.

Defined cases: a null text has no words; texts shorter than the window lose
nothing; a null id counts as the largest one; of rows that share an id, a
window is covered only by one with a smaller id or start; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Groups of documents per shuffle partition: the unit that a task holds at a time.
GROUPS = 2
#: Entries that a batch gathers before it deals them out.
GATHER = 1 << 21
_LAST = np.iinfo(np.int64).max
_START = np.int64((1 << 40) - 1)
#: h: hash; g: another hash, of the full windows alone; d: document; q: start word, and above 40 bits the number of the row among those of its id.
DEALT = "bucket int, h binary, g binary, d binary, q binary, settled_d binary, settled_q binary"
FOUND = "part long, d binary, q binary"


def stand_ins(half_hashes: np.ndarray, span: int) -> np.ndarray:
    """Of each run of ``span`` hashes: the place of the smallest, the first one of equals."""
    n = len(half_hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = half_hashes[:n].copy()
    at = np.zeros(n, np.int64)
    for k in range(1, span):
        lower = half_hashes[k : k + n] < best
        at[lower] = k
        np.copyto(best, half_hashes[k : k + n], where=lower)
    return at + np.arange(n)


class TextWindows:
    """Full windows of a slice of texts: start words, and the stand-in of each."""

    def __init__(self, w: common.Words, window: int):
        half = window // 2
        span = window - half + 1
        self.w, self.hashes = w, w.hashes()
        n = len(self.hashes)
        if n < window:
            self.starts = self.chosen = np.zeros(0, np.int64)
            self.half_hashes = np.zeros(0, np.uint64)
            return
        every = np.arange(n - half + 1)
        self.half_hashes = common.span_hash(self.hashes, every, every + half)
        inside = w.doc[: n - window + 1] == w.doc[window - 1 :]
        self.starts = np.flatnonzero(inside)
        self.chosen = stand_ins(self.half_hashes, span)[self.starts]


def _repeats(h: np.ndarray, g: np.ndarray, d: np.ndarray, q: np.ndarray, any_repeat: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the entries by hash and place; which of them, so ordered, begin a hash; which of them are found to repeat.

    any_repeat: all occurrences of a repeated hash (level one); else all but
    those at the first place (level two).
    """
    order = np.lexsort((q & _START, d, g, h)) if len(g) else np.lexsort((q & _START, d, h))
    h, d, q = h[order], d[order], q[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if len(g):
        g = g[order]
        new[1:] |= g[1:] != g[:-1]
    group = np.cumsum(new) - 1
    if any_repeat:
        return order, new, (np.bincount(group)[group] > 1) if len(h) else new
    first = np.flatnonzero(new)[group]
    return order, new, (d != d[first]) | ((q & _START) != (q[first] & _START))


def _deal(h: np.ndarray, g: np.ndarray, d: np.ndarray, q: np.ndarray, buckets: int, any_repeat: bool) -> pa.RecordBatch:
    """Settle repeats among these entries; deal the first of each hash, and the settled ones, to buckets."""
    order, new, settled = _repeats(h, g, d, q, any_repeat)
    h, g, d, q = h[order], g[order] if len(g) else g, d[order], q[order]
    if not any_repeat:  # all rows at the first place stay in play
        new = new | ~settled
    bucket = (common.mix64(h) >> np.uint64(33)) % np.uint64(buckets)
    # settled entries go anywhere, evenly
    spread = (common.mix64(d.view(np.uint64) ^ np.uint64(0x5BD1E995)) >> np.uint64(33)) % np.uint64(buckets)
    rows: dict[int, list[bytes]] = {}
    for first, which, to, parts in ((0, new, bucket, (h, g, d, q)), (4, settled, spread, (d, q))):
        at = np.flatnonzero(which)
        at = at[np.argsort(to[at], kind="stable")]
        names, begin = np.unique(to[at], return_index=True)
        for b, i, j in zip(names.tolist(), begin.tolist(), [*begin[1:].tolist(), len(at)][: len(names)], strict=True):
            row = rows.setdefault(int(b), [b""] * 6)
            row[first : first + len(parts)] = [x[at[i:j]].tobytes() if len(x) else b"" for x in parts]
    columns = list(zip(*rows.values(), strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=[c.split()[0] for c in DEALT.split(", ")])


def _gather(batches: Iterable[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    held: dict[str, list[bytes]] = {n: [] for n in names}
    for b in batches:
        for n in names:
            held[n] += b.column(n).to_pylist()
    return [np.frombuffer(b"".join(held[n]), np.uint64 if n in "hg" else np.int64) for n in names]


def _settle(dealt: DataFrame, parts: int, buckets: int, any_repeat: bool) -> DataFrame:
    """Decide each bucket's hashes; send what is found back to the parts of the documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g, d, q, more_d, more_q = _gather(batches, ["h", "g", "d", "q", "settled_d", "settled_q"])
        order, _, found = _repeats(h, g, d, q, any_repeat)
        d, q = np.concatenate([d[order][found], more_d]), np.concatenate([q[order][found], more_q])
        part = d % np.int64(parts)
        order = np.argsort(part, kind="stable")
        d, q, part = d[order], q[order], part[order]
        names, begin = np.unique(part, return_index=True)
        ends = [*begin[1:].tolist(), len(part)]
        if len(names):
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(begin.tolist(), ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names), cut(d), cut(q)], names=["part", "d", "q"])

    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(run, FOUND)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def first_level(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Stand-ins of all full windows, dealt by hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            ids = _ids(batch.column("doc_id"))
            for i, _, w in common.batches_of(batch, "text"):
                t = TextWindows(w, window)
                at = np.unique(t.chosen)
                doc = w.doc[at]
                held.append((t.half_hashes[at], np.zeros(0, np.uint64), ids[i + doc], at - w.bounds[doc]))
                count += len(at)
                if count >= GATHER:
                    yield _deal(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets, True)
                    held, count = [], 0
        if count:
            yield _deal(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets, True)

    return docs.mapInArrow(run, DEALT)


class Group:
    """The documents of one part, in order of id and text, and positions found in them."""

    def __init__(self, docs: pa.Table, found: pa.Table):
        docs = docs.combine_chunks()
        ids = _ids(docs.column("doc_id").combine_chunks() if docs.num_rows else pa.array([], pa.int64()))
        if len(np.unique(ids)) < len(ids):  # rows that share an id get a fixed order
            order = np.asarray(sorted(range(len(ids)), key=lambda k: (ids[k], docs.column("text")[k].as_py() or "")))
        else:
            order = np.argsort(ids, kind="stable")
        self.docs, self.ids = docs.take(pa.array(order)), ids[order]
        same = np.zeros(len(ids), np.int64)
        for k in range(1, len(ids)):
            if self.ids[k] == self.ids[k - 1]:
                same[k] = same[k - 1] + 1
        self.number = same
        text = self.docs.column("text").combine_chunks() if len(ids) else pa.array([], pa.string())
        self.data, self.offsets = common.text_buffers(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
        self.d, self.q = _gather(found.to_batches(), ["d", "q"])

    def slices(self) -> Iterator[tuple[int, int, common.Words]]:
        for i, j in common.slices(self.offsets):
            yield i, j, common.Words(self.data, self.offsets[i : j + 1])

    def marks(self, i: int, j: int, w: common.Words, numbered: bool) -> np.ndarray:
        """Words of rows i to j at which something was found."""
        out = np.zeros(len(w.starts), bool)
        ids = self.ids[i:j]
        within = (self.d >= ids[0]) & (self.d <= ids[-1])
        d, q = self.d[within], self.q[within]
        row = np.searchsorted(ids, d)
        tries = 1 if numbered else int(self.number[i:j].max()) + 1
        for k in range(tries):
            r = row + (np.right_shift(q, 40) - self.number[i:j][np.minimum(row, j - i - 1)] if numbered else k)
            ok = (r >= 0) & (r < j - i)
            ok[ok] &= ids[r[ok]] == d[ok]
            at = w.bounds[r[ok]] + (q[ok] & _START)
            ok = at < w.bounds[r[ok] + 1]
            out[at[ok]] = True
        return out


def second_level(docs: DataFrame, found: DataFrame, window: int, buckets: int, every: bool = False) -> DataFrame:
    """Full windows whose stand-in repeats, dealt by hash. every: the first place counts as a repeat too."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g = Group(left, right)
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(g.d):
            for i, j, w in g.slices():
                t = TextWindows(w, window)
                at = t.starts[g.marks(i, j, w, False)[t.chosen]]
                doc = w.doc[at]
                if not len(at):
                    continue
                second = common.span_hash(w.hashes(other=True), at, at + window, other=True)
                held.append((common.span_hash(t.hashes, at, at + window), second, g.ids[i + doc], (g.number[i + doc] << 40) + at - w.bounds[doc]))
        return pa.Table.from_batches([_deal(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets, every)])

    return docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, DEALT)


def apply_removals(docs: DataFrame, found: DataFrame, window: int, texts: bool) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g = Group(left, right)
        rows = []
        for i, j, w in g.slices():
            depth = np.zeros(len(w.starts) + 1, np.int64)
            at = np.flatnonzero(g.marks(i, j, w, True))
            depth[at] += 1
            depth[at + window] -= 1
            keep = np.cumsum(depth[:-1]) == 0
            for k in range(j - i):
                a, b = int(w.bounds[k]), int(w.bounds[k + 1])
                words = w.data[w.offsets[k] : w.offsets[k + 1]].tobytes().split()
                stay = keep[a:b]
                left_over = b" ".join(words if stay.all() else compress(words, stay.tolist()))
                rows.append((b - a, int(b - a - stay.sum()), hashlib.sha256(left_over).hexdigest(), left_over.decode() if texts else ""))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 if texts else 3]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        ids = pa.array(g.ids, mask=g.ids == _LAST)
        return pa.table([ids, *columns], names=[c.split()[0] for c in schema.split(", ")])

    return docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, schema)


def _doubled(docs: DataFrame, found: DataFrame, length: int, buckets: int) -> DataFrame:
    """Windows of ``length`` words whose halves both repeat, dealt by hash."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g = Group(left, right)
        none = np.zeros(0, np.uint64)
        held = [(none, none, none.view(np.int64), none.view(np.int64))]
        if len(g.d):
            for i, j, w in g.slices():
                marks = g.marks(i, j, w, True)
                at = np.flatnonzero(marks[: -(length // 2)] & marks[length // 2 :]) if len(marks) > length // 2 else np.zeros(0, np.int64)
                at = at[at + length <= len(marks)]
                at = at[w.doc[at] == w.doc[at + length - 1]]
                if not len(at):
                    continue
                doc = w.doc[at]
                one, two = (common.span_hash(w.hashes(o), at, at + length, o) for o in (False, True))
                held.append((one, two, g.ids[i + doc], (g.number[i + doc] << 40) + at - w.bounds[doc]))
        return pa.Table.from_batches([_deal(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets, True)])

    return docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, DEALT)


def _grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, int, int]:
    width = common.width(docs.sparkSession, docs)
    parts = GROUPS * width + 1
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim, slim.withColumn("part", F.pmod(F.coalesce("doc_id", F.lit(int(_LAST))), F.lit(parts))), width, parts


def longest_repeats(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every document with a repeated window: the longest length ``window``, 2 ``window``, 4 ``window``, ...
    at which a window of it occurs at another place too. One row per id: ``doc_id, words``."""
    slim, grouped, width, parts = _grouped(docs, key, text)
    repeated = _settle(first_level(slim, window, width), parts, width, True)
    level, length, levels = _settle(second_level(grouped, repeated, window, width, every=True), parts, width, True), window, []
    while True:
        level = common.durable(level)
        if not level.limit(1).count():  # no candidate survives
            break
        levels.append(level.mapInArrow(_documents, "doc_id long").distinct().select("doc_id", F.lit(length).cast("long").alias("words")))
        length *= 2
        level = _settle(_doubled(grouped, level, length, width), parts, width, True)
    if not levels:
        return docs.sparkSession.createDataFrame([], "doc_id long, words long")
    return reduce(DataFrame.union, levels).groupBy("doc_id").agg(F.max("words").alias("words"))


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = np.unique(np.frombuffer(b"".join(b.column("d").to_pylist()), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == _LAST)], names=["doc_id"])


def dedup_substrings(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """Words, removed words and digest of the kept words of every row; with ``texts``, the kept text too."""
    if window < 2:
        raise ValueError("a window has at least two words")
    slim, grouped, width, parts = _grouped(docs, key, text)
    repeated = _settle(first_level(slim, window, width), parts, width, True)
    covered = _settle(second_level(grouped, repeated, window, width), parts, width, False)
    return apply_removals(grouped, covered, window, texts)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.read(spark, sf_dir, "documents"))
