"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is its set of hashed five-word shingles. A forest of ``TREES``
sorted prefix tries holds one label of ``DEPTH`` minhashes per document and
tree. Each document starts with its whole labels as matched prefixes and
shortens them one minhash at a time, in each step in the tree where the
shorter prefix is shared by the fewest others, until the chance that it meets
a set at the threshold in some tree reaches the target recall. So a document
keeps long prefixes where its tries are crowded and short ones where they are
not. All documents below a prefix that one of them has asked for are matched
with each other. They come in trie order, so those that share longer prefixes
meet first: the first of them becomes a leader and takes in all that the
signatures put near it. Leaders' stars join into candidate components (a
superset of the true ones), and inside each component all pairs of sets are
compared exactly, in blocks, and counted without being written out.

Copies (equal sets) are one node throughout. A hot node or component is cut
into salted parts or pairs of blocks, so no task gets an unbounded group: the
rows of each part of a node meet the leaders of every other part, so a cut node
joins what a whole one would.

Defined cases: a null text has no words; texts of one to four words have one
shingle, of all their words; a text without words is alone in its class; rows
with a null id have a null class and no link; rows that share an id count as
one document; other columns are ignored, or kept by ``keep_one``, which keeps
one row of each class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, TREES, DEPTH = 5, 16, 6


@dataclass(frozen=True)
class Forest:
    """threshold: least Jaccard similarity; recall: least chance that a pair at the threshold meets."""

    threshold: float = 0.8
    recall: float = 0.999
    #: documents of one node, or of one component, that one task compares at a time
    block: int = 512
    salt: int = 4096

    def depth(self) -> int:
        """Prefix length at which the target recall is reached in any case: no prefix gets shorter."""
        d = DEPTH
        while d > 1 and 1 - (1 - self.threshold**d) ** TREES < self.recall:
            d -= 1
        return d

    def shortened(self, shared: np.ndarray) -> np.ndarray:
        """Matched prefixes' lengths of each document and tree.

        shared: of each document, tree and length from ``depth()`` on, how many have the same prefix.
        """
        least = self.depth()
        at = np.full(shared.shape[:2], DEPTH)
        rows = np.arange(len(at))
        while True:
            missed = np.log1p(-(self.threshold**at)).sum(1)  # the chance to meet in no tree
            rows = rows[(missed[rows] > np.log1p(-self.recall)) & (at[rows] > least).any(1)]
            if not len(rows):
                return at
            shorter = at[rows] - 1 - least
            size = np.take_along_axis(shared[rows], np.maximum(shorter, 0)[:, :, None], 2)[:, :, 0]
            # of equal ones the longest prefix goes first
            cost = np.where(shorter < 0, np.inf, size * (DEPTH + 1) - at[rows])
            at[rows, cost.argmin(1)] -= 1

    def similar(self, inter: np.ndarray, union: np.ndarray) -> np.ndarray:
        return 10_000 * inter >= round(10_000 * self.threshold) * union


def shingle_sets(w: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, in text order, and the bounds of each text's."""
    words = w.hashes()
    at, hashes = w.windows(words, SHINGLE)
    n = np.diff(w.bounds)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    doc = np.concatenate([w.doc[at], short])
    hashes = np.concatenate([hashes, common.span_hash(words, w.bounds[short], w.bounds[short + 1])])
    with np.errstate(over="ignore"):
        key = common.mix64(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    first = first[np.argsort(doc[first], kind="stable")]
    return hashes[first], np.searchsorted(doc[first], np.arange(len(n) + 1))


def minhashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minhashes of each text with a shingle; zeros for the others."""
    k = TREES * DEPTH
    out = np.zeros((len(bounds) - 1, k), np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        mult, add = common.seeds(k, 3), common.seeds(k, 4)
        y = np.empty_like(x)
        for i in range(k):
            np.bitwise_xor(x, np.uint32(int(add[i]) & 0xFFFFFFFF), out=y)
            np.multiply(y, np.uint32(int(mult[i]) & 0xFFFFFFFF | 1), out=y)
            out[full, i] = np.minimum.reduceat(y, bounds[full])
    return out


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: set key of 128 bits, number of shingles, signature."""
    schema = "doc_id long, k1 long, k2 long, n int, sig binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("near")
        for batch in batches:
            ids = batch.column(key).cast(pa.int64())
            for i, j, w in common.batches_of(batch, text):
                hashes, bounds = shingle_sets(w)
                sig = minhashes(hashes, bounds)
                sums = []
                for salt in (5, 6):
                    total = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(common.mix64(hashes ^ common.seeds(1, salt)), out=total[1:])
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                rows = [pa.array(s) for s in sums]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *rows, pa.array(np.diff(bounds).astype(np.int32)), pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "k1", "k2", "n", "sig"])
        common.trim()

    return docs.select(key, text).mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _nodes(reps: DataFrame, least: int) -> DataFrame:
    """The trie nodes of each representative: a 64-bit name for each tree and each depth from ``least`` on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = _matrix(b.column("sig"), TREES * DEPTH, "<u4").reshape(-1, TREES, DEPTH).astype(np.uint64)
            names = []
            with np.errstate(over="ignore"):
                name = np.broadcast_to(common.seeds(TREES, 7), sig.shape[:2]).copy()
                for d in range(DEPTH):
                    name = common.mix64(name * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, d])
                    names.append(name)
            name = np.stack(names[least - 1 :], 2)  # document, tree, depth
            place = np.arange(TREES, dtype=np.int16)[:, None] * 16 + np.arange(least, DEPTH + 1, dtype=np.int16)
            rep = np.repeat(b.column("rep").to_numpy(), place.size)
            yield pa.RecordBatch.from_arrays([pa.array(name.ravel().view(np.int64)), pa.array(rep), pa.array(np.tile(place.ravel(), b.num_rows))], names=["node", "rep", "place"])

    return reps.select("rep", "sig").mapInArrow(run, "node long, rep long, place short")


def _asked(shared: DataFrame, forest: Forest) -> DataFrame:
    """The nodes that some document's matched prefixes end in, of those that it shares with others."""
    least = forest.depth()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("nodes")
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            node, place, c = (lists.flatten().field(k).to_numpy() for k in range(3))
            tree, depth = place // 16, place % 16
            size = np.ones((b.num_rows, TREES, DEPTH + 1 - least), np.int64)
            size[row, tree, depth - least] = c
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[forest.shortened(size)[row, tree] == depth]))], names=["node"])

    # at most one entry for each tree and depth
    lists = shared.groupBy("rep").agg(F.collect_list(F.struct("node", "place", "c")).alias("nodes"))
    return lists.select("nodes").mapInArrow(run, "node long").distinct()


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of batches that come sorted by integer keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        if held:
            change[0] = any(h[0] != held[-1].column(k)[-1].as_py() for h, k in zip(cols, keys, strict=True))
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        start = 0
        for stop in np.flatnonzero(change).tolist():
            if stop > start:
                held.append(b.slice(start, stop - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], stop
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


#: Chance differences of an estimate from TREES * DEPTH minhashes stay within this.
NOISE = 0.2


def _reach(near: float) -> float:
    """Least estimate of a row and the leader of a row that is similar to it."""
    return max(0.0, 2 * near - 1) - NOISE


def links_across(sig: np.ndarray, leads: np.ndarray, near: float) -> list[tuple[int, int]]:
    """Links of the rows of one part of a node to the leaders of another, within reach of two steps."""
    reach = _reach(near)
    part = np.arange(len(leads))  # of each leader: the part it has been joined to
    links: list[tuple[int, int]] = []
    for i in range(len(sig)):
        alike = np.flatnonzero((leads == sig[i]).mean(1) >= reach)
        parts, first = np.unique(part[alike], return_index=True)
        links += [(i, k) for k in alike[first].tolist()]
        if len(parts) > 1:
            part[np.isin(part, parts)] = parts[0]
    return links


def leaders_of(sig: np.ndarray, near: float) -> tuple[list[int], list[tuple[int, int]]]:
    """Leader clustering in the given order: leaders, and links of rows to leaders.

    A row within ``near`` of no earlier leader leads. Rows are joined to all
    leaders within reach of two steps, so any two rows that are similar to each
    other are joined through the leader of one of them. Links form a forest.
    """
    reach = _reach(near)
    leaders: list[int] = []
    part = np.zeros(len(sig), np.int64)  # of each leader: the part it has been joined to
    links: list[tuple[int, int]] = []
    for i in range(len(sig)):
        alike = (sig[leaders] == sig[i]).mean(1) if leaders else np.zeros(0)
        parts, first = np.unique(part[: len(leaders)][alike >= reach], return_index=True)
        hits = np.flatnonzero(alike >= reach)[first]
        links += [(i, leaders[k]) for k in hits]  # one link to each part is enough
        if len(parts) > 1:
            part[: len(leaders)][np.isin(part[: len(leaders)], parts)] = parts[0]
        if not (alike >= near).any():
            part[len(leaders)] = parts[0] if len(parts) else len(leaders)
            leaders.append(i)
    return leaders, links


def _stars(members: DataFrame, near: float, width: int) -> DataFrame:
    """Leader clustering of each (node, salt): links, and leaders (``b`` null) of cut nodes for the next round."""
    schema = "node long, a long, b long, sig binary, salt long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for t in grouped(batches, ["node", "salt"]):
            t = t.combine_chunks()
            rep, raw = t.column("rep").to_numpy(), t.column("sig").to_pylist()
            node, salt, cut = (t.column(c)[0].as_py() for c in ("node", "salt", "cut"))
            leaders, links = leaders_of(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), near)
            out += [(node, int(rep[i]), int(rep[k]), None, salt) for i, k in links if rep[i] != rep[k]]
            if cut:
                out += [(node, int(rep[k]), None, raw[k], salt) for k in leaders]
            if len(out) > 10_000:
                yield _star_rows(out)
                out = []
        if out:
            yield _star_rows(out)

    dealt = members.repartition(width, "node", "salt").sortWithinPartitions("node", "salt", "label", "rep")
    return dealt.select("node", "salt", "rep", "sig", "cut").mapInArrow(run, schema)


def _star_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "a", "b", "sig", "salt"])


def _across(members: DataFrame, leaders: DataFrame, near: float, width: int) -> DataFrame:
    """The parts of each cut node in pairs: the rows of one meet the leaders of the other, as they would in a whole node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["node", "p", "q"]):
            t = t.combine_chunks()
            rep, lead = t.column("rep").to_numpy(), t.column("lead").to_numpy().astype(bool)
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(rep), -1)
            links = links_across(sig[~lead], sig[lead], near)
            if links:
                i, k = np.asarray(links).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[~lead][i]), pa.array(rep[lead][k])], names=["a", "b"])

    columns = ["node", "p", "q", "rep", "sig", "lead"]
    low = members.filter("salt < parts - 1").withColumns({"p": F.col("salt"), "q": F.explode(F.sequence(F.col("salt") + 1, F.col("parts") - 1)), "lead": F.lit(0)})
    high = leaders.filter("salt > 0").withColumns({"p": F.explode(F.sequence(F.lit(0).cast("long"), F.col("salt") - 1)), "q": F.col("salt"), "lead": F.lit(1)})
    dealt = low.select(columns).union(high.select(columns)).repartition(width, "node", "p", "q").sortWithinPartitions("node", "p", "q")
    return dealt.mapInArrow(run, "a long, b long")


def _tangles(e: DataFrame) -> int:
    """Nodes that hang on two others, or on one and have others hanging on them: without any, ``e`` holds stars alone."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("least")).filter("n > 1 or n = 1 and least = 0").count()


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``node`` and ``root``, its smallest member, of every node with an edge.

    Alternating star contractions: each round hangs the larger neighbours of
    a node, then the smaller ones and itself, on its smallest, until only stars
    are left. Only aggregates and joins of (node, node) rows; the state of each
    round is checkpointed. What a round repeats is dropped at its end alone, so it takes five shuffles.
    """
    e = common.durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while _tangles(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e1 = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        hung = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = common.durable(e1.join(low, "u").select(hung.alias("x")).select("x.*").filter("u != v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def candidates(reps: DataFrame, forest: Forest, width: int | None = None) -> DataFrame:
    """Candidate components of the representatives that share a node. width: tasks of its shuffles."""
    width = width or common.width(reps.sparkSession)
    nodes = _nodes(reps, forest.depth())
    counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = common.durable(nodes.join(counts, "node"))
    # a node below another one that is asked for adds nothing: of each tree the highest stays
    depth = F.pmod("place", F.lit(16))
    below = shared.join(_asked(shared, forest), "node", "left_semi").withColumn("tree", F.shiftright("place", 4))
    shared = below.groupBy("rep", "tree").agg(F.min(F.struct(depth.alias("depth"), "node", "c")).alias("m")).select("rep", "tree", "m.node", "m.c")
    # one byte of each minhash is enough to estimate by
    slim = reps.mapInArrow(_slim, "rep long, sig binary, labels binary")
    rows = shared.join(slim, "rep").withColumns({
        "parts": F.ceil(F.col("c") / F.lit(forest.salt)),
        "label": F.substring("labels", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH)),
    })
    rows = rows.withColumns({"salt": F.pmod(F.xxhash64("node", "rep"), "parts"), "cut": F.col("parts") > 1})
    near = forest.threshold
    edges = common.durable(_stars(rows, near, width))
    links = edges.filter("b is not null").select("a", "b")
    leaders = edges.filter("b is null").select("node", "salt", F.col("a").alias("rep"), "sig")
    if leaders.limit(1).count():
        links = links.union(_across(rows.filter("cut"), leaders, near, width))
    return components(links)


def _slim(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sig = _matrix(b.column("sig"), TREES * DEPTH, "<u4")
            low = (sig >> np.uint32(8)).astype(np.uint8)
            big = sig.astype(">u4")  # bytes in the order of the numbers, for sorting
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([r.tobytes() for r in low], pa.binary()), pa.array([r.tobytes() for r in big], pa.binary())], names=["rep", "sig", "labels"])


def compare(sets: list[np.ndarray], side: np.ndarray, cross: bool, similar: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Matrix of similar pairs among sets; with ``cross``, only of pairs from different sides."""
    n = len(sets)
    sizes = np.asarray([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    often = counts >= 2
    column = np.cumsum(often) - 1
    keep = often[inverse]
    row, col = row[keep], column[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((n, n), np.float32)
    step = 4096
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(col, [lo, lo + step])
        m = np.zeros((n, min(step, int(often.sum()) - lo)), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        inter += m @ m.T
    inter = inter.astype(np.int64)
    found = similar(inter, sizes[:, None] + sizes[None, :] - inter)
    np.fill_diagonal(found, False)
    if cross:
        found &= side[:, None] != side[None, :]
    return found


def verify(members: DataFrame, forest: Forest, width: int) -> DataFrame:
    """Exact comparison inside candidate components, by pairs of blocks.

    members: root, rep, size (copies), blocks, text. Returns per block pair
    and representative the documents linked to it and its smallest neighbour.
    """
    schema = "rep long, links long, parent long, cut boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("near")
        out: list[np.ndarray] = []
        for t in grouped(batches, ["root", "p", "q"]):
            t = t.combine_chunks()
            if t.num_rows < 2:
                continue
            rep, size, side = (t.column(c).to_numpy() for c in ("rep", "size", "block"))
            p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
            data, offsets = common.text_buffers(t.column("text").chunk(0))
            sets: list[np.ndarray] = []
            for i, j in common.slices(offsets):
                hashes, bounds = shingle_sets(common.Words(data, offsets[i : j + 1]))
                sets += [hashes[a:b].copy() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            found = compare(sets, side, p != q, forest.similar) & (rep[:, None] != rep[None, :])
            links = found @ size
            parent = np.where(found.any(1), np.where(found, rep[None, :], rep.max()).min(1), rep)
            parent = np.minimum(parent, rep)
            while True:  # smallest member of each part of the group
                lower = np.minimum(parent, np.where(found, parent[None, :], parent.max()).min(1))
                if (lower == parent).all():
                    break
                parent = lower
            hit = links > 0
            if hit.any():
                out.append(np.stack([rep[hit], links[hit], parent[hit], np.full(int(hit.sum()), t.column("blocks")[0].as_py() > 1)]))
            if len(out) > 2000:
                yield _verified(out)
                out = []
        if out:
            yield _verified(out)

    block = members.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    other = block.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = other.withColumns({"p": F.least("block", "o"), "q": F.greatest("block", "o")}).drop("o")
    dealt = pairs.repartition(width, "root", "p", "q").sortWithinPartitions("root", "p", "q")
    return dealt.select("root", "p", "q", "rep", "size", "block", "blocks", "text").mapInArrow(run, schema)


def _verified(parts: list[np.ndarray]) -> pa.RecordBatch:
    rep, links, parent, cut = np.concatenate(parts, 1).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(parent), pa.array(cut.astype(bool))], names=["rep", "links", "parent", "cut"])


def near_classes(docs: DataFrame, forest: Forest = Forest(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id`` (smallest id of its group), ``copy_id`` (smallest id with
    the same shingles) and ``n_links`` (other documents at or above the threshold, copies included)."""
    width = common.width(docs.sparkSession, docs)
    sig = common.durable(signatures(docs, key, text))
    whole = sig.filter("n > 0 and doc_id is not null")
    classes = common.durable(whole.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "sig")).alias("m"), F.count(F.lit(1)).alias("size")).select("k1", "k2", "m.doc_id", "m.sig", "size").withColumnRenamed("doc_id", "rep"))
    found = candidates(classes.select("rep", "sig"), forest, width)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    tagged = found.join(sizes, "root").join(classes.select(F.col("rep").alias("node"), "size"), "node").select("root", F.col("node").alias("rep"), "size", F.ceil(F.col("members") / F.lit(forest.block)).alias("blocks"))
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text"))
    checked = common.durable(verify(tagged.join(texts, "rep"), forest, width))
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"), F.min("parent").alias("parent"))
    cut = checked.filter("cut").select(F.col("rep").alias("a"), F.col("parent").alias("b"))
    if cut.limit(1).count():  # a component compared in several blocks: its parts are joined
        roots = components(cut).select(F.col("node").alias("rep"), "root")
        links = links.join(roots, "rep", "left").select("rep", "links", F.coalesce("root", "parent").alias("parent"))
    judged = classes.select("k1", "k2", "rep", "size").join(links, "rep", "left")
    out = whole.select("doc_id", "k1", "k2").join(judged, ["k1", "k2"]).select("doc_id", F.coalesce("parent", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = sig.filter("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(alone)


def keep_one(docs: DataFrame, forest: Forest = Forest(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, whole: of each class one row with its smallest id, and all rows without an id."""
    gone = near_classes(docs, forest, key, text).filter("doc_id != class_id").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs[key] == gone["__gone"], "left_anti")
    twice = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col(key).alias("__gone"))
    if not twice.limit(1).count():
        return left
    # of rows that share an id, the one with the smallest hash stays
    once = left.join(twice, left[key] == twice["__gone"], "left_anti")
    again = left.join(twice, left[key] == twice["__gone"], "left_semi")
    row = F.struct(*(docs[c] for c in docs.columns))
    one = again.select(F.col(key).alias("__k"), F.xxhash64(text).alias("__h"), row.alias("__row")).groupBy("__k").agg(F.min_by("__row", "__h").alias("__row"))
    return once.union(one.select("__row.*"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(common.read(spark, sf_dir, "documents"))
