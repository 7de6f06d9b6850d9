"""Cross-tokenizer alignment by a string of labels, one for each byte.

Two tokenizers cut the same bytes. Every byte is labelled: no token ends here,
one of A does, one of B does, or one of both. A regular expression scans the
label string for spans up to each both-label; such a span is a group, and its
labels count the tokens of each side in it. Inside a group every labelled byte
ends one overlap of a token of A with one of B, so labels give the links too.

Both tokenizers always end a token where a space follows a character that is
not white (no token holds such a space but as its first one; checked when the
vocabularies are read). So a text is cut there, and a distinct part is encoded
and scanned once for all its occurrences: parts are looked up by hash and
compared with their code points (``pieces``).

Corpus-wide counts of linked id pairs are summed once; those of frequent pairs
and each A id's highest count go to every task, rare pairs are joined
(``lookups``).

Defined cases: null and empty texts have no tokens, nor do those whose joined
token bytes differ from a space and the text (for example with U+2581 in
them); their columns are zero, or '' for the digest; special strings in texts
are plain text; every row is a document of its own, so repeated rows count as
often as they occur; a null id stays; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, lookups, pieces
from .token_counts import byte_alphabet, kinds

#: Distinct parts that a worker remembers, and id pairs whose counts go to every task.
REMEMBERED, KNOWN = 1_000_000, 1 << 20
#: Parts that are encoded as one text.
JOINED = 2000
#: Labels of a byte: no end, an end of A, of B, of both.
LABELS = b"-ab+"
GROUP = re.compile(rb"[-ab]*\+")


class Parts(pieces.Store):
    """Of each distinct part: tokens of A and B and groups (all zero if it has none), then its links; and its groups as text, each with a semicolon behind it."""

    def _clear(self) -> None:
        super()._clear()
        self.groups: list[bytes] = []


class Aligner:
    """Two tokenizers, and what is known of parts of texts."""

    def __init__(self, byte_path: str, piece_path: str, remember: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        import sentencepiece
        from tokenizers import Tokenizer

        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
            raise ValueError(f"{byte_path}: not a byte-level vocabulary that cuts before spaces")
        self.one = Tokenizer.from_file(byte_path)
        self.one.encode_special_tokens = True
        to_byte = byte_alphabet()
        vocab = self.one.get_vocab()
        self.one_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.one_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.two = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.two.id_to_piece(i) for i in range(self.two.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names) or "".join(self.two.encode(" a  b ", out_type=str)) != "▁▁a▁▁b▁":
            raise ValueError(f"{piece_path}: tokens may span a space after other characters")
        self.two_bytes = [bytes([int(p[3:5], 16)]) if self.two.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.one_size, self.two_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.one_bytes, self.two_bytes))
        # decimal ids, each with what may follow it
        self.names = [b"%d%c" % (i, c) for i in range(len(self.one_bytes)) for c in b",|"] + [b"%d%c" % (i, c) for i in range(len(self.two_bytes)) for c in b",;"]
        self.name_size = np.fromiter(map(len, self.names), np.int64, len(self.names))
        self.store = Parts(remember, "<i8")

    def cut(self, s: pieces.Slice) -> np.ndarray:
        """Starts of the parts: of each text, and spaces after a character that is not white, unless only spaces follow."""
        n = len(s.codes)
        first = np.zeros(n + 1, bool)
        first[s.bounds] = True
        first = first[:n]
        space = s.codes == 0x20
        mark = space.copy()
        mark[1:] &= kinds()[s.codes[:-1]] > pieces.OTHER_SPACE
        mark &= ~first
        at = np.flatnonzero(mark)
        if len(at):
            solid = np.flatnonzero(~space)
            following = np.searchsorted(solid, at)
            after = np.append(solid, n)[following]
            at = at[after < s.bounds[np.searchsorted(s.bounds, at, "right")]]
        return np.union1d(np.flatnonzero(first), at)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B of parts as one text each, joined."""
        one = [e.ids for e in self.one.encode_batch_fast(texts, add_special_tokens=False)]
        two = self.two.encode([t[1:] for t in texts], num_threads=1)
        return tuple(np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (one, two))

    def _joined(self, texts: list[str], raw: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], ...]:
        """Ids of A and of B, and how many each part has, in runs of many parts: those that end in a character that is not white
        are encoded as one text, which is cut at their ends anyway."""
        ids, sizes = ([], []), np.fromiter(map(len, raw), np.int64, len(raw))
        for lo in range(0, len(texts), JOINED):
            hi = min(lo + JOINED, len(texts))
            found = self._encoded(["".join(texts[lo:hi])])
            whole = b"".join(raw[lo:hi])
            ends = np.cumsum(sizes[lo:hi])
            fits = all(b"".join(map(names.__getitem__, x.tolist())) == whole for x, names in zip(found, (self.one_bytes, self.two_bytes), strict=True))
            stops = [np.cumsum(size[x]) for x, size in zip(found, (self.one_size, self.two_size), strict=True)] if fits else []
            if fits and all(np.isin(ends, stop).all() for stop in stops):
                cuts = [np.searchsorted(stop, ends, "right") for stop in stops]
            else:  # some part is not what its tokens say: each one by itself
                alone = [self._encoded([t]) for t in texts[lo:hi]]
                found = [np.concatenate([x[k] for x in alone]) for k in (0, 1)]
                cuts = [np.cumsum([len(x[k]) for x in alone]) for k in (0, 1)]
            for k in (0, 1):
                ids[k].append((found[k], np.diff(cuts[k], prepend=0)))
        return ids

    def _make(self, texts: list[str], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of new parts: tokens, groups and links; their groups' text goes to the store."""
        raw = [t.encode() for t in texts]
        white = np.fromiter((t[-1].isspace() or not t[-1].isprintable() for t in texts), bool, len(texts))
        order = np.argsort(white, kind="stable")
        plain = int(len(texts) - white.sum())
        texts, raw = [texts[i] for i in order.tolist()], [raw[i] for i in order.tolist()]
        made = self._joined(texts[:plain], raw[:plain])
        for t in texts[plain:]:
            for k, x in enumerate(self._encoded([t])):
                made[k].append((x, np.asarray([len(x)])))
        (a, na), (b, nb) = ((np.concatenate(x) for x in zip(*m, strict=True)) for m in made)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        good = self._faithful(a, na, b, nb, raw, size)
        a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        na, nb, size = na * good, nb * good, size * good
        label = np.zeros(int(size.sum()), np.uint8)
        label[np.cumsum(self.one_size[a]) - 1] += 1
        label[np.cumsum(self.two_size[b]) - 1] += 2
        ends = np.flatnonzero(label)
        kind = label[ends]
        # the token of each side that the overlap ending here is part of
        links = (a[np.cumsum(kind & 1, dtype=np.int64) - (kind & 1)] << 32) | b[np.cumsum(kind >> 1, dtype=np.int64) - (kind >> 1)]
        # groups: spans of labels up to one of both
        spans = np.fromiter((m.end() for m in GROUP.finditer(np.frombuffer(LABELS, np.uint8)[label].tobytes())), np.int64)
        one_ends, two_ends = np.searchsorted(ends[(kind & 1) > 0], spans - 1, "right"), np.searchsorted(ends[kind > 1], spans - 1, "right")
        names, place = self._names(a, b, one_ends, two_ends)
        stops = np.cumsum(size)
        groups = np.diff(np.searchsorted(spans, stops, "right"), prepend=0)
        n_links = np.diff(np.searchsorted(ends, stops - 1, "right"), prepend=0) * (size > 0)
        text_ends = np.concatenate([[0], place])[np.cumsum(groups)].tolist()
        held = [names[i:j] for i, j in zip([0, *text_ends], text_ends, strict=False)]
        facts = np.stack([na, nb, groups], 1)
        sizes = 3 + n_links
        flat = np.empty(int(sizes.sum()), np.int64)
        head = np.cumsum(sizes) - sizes
        flat[head[:, None] + np.arange(3)] = facts
        rest = np.ones(len(flat), bool)
        rest[head[:, None] + np.arange(3)] = False
        flat[rest] = links
        back = np.argsort(order)
        self.store.groups += [held[i] for i in back.tolist()]
        return flat[pieces.spread(head[back], sizes[back])], sizes[back]

    def _faithful(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, raw: list[bytes], size: np.ndarray) -> np.ndarray:
        """Which parts' bytes are those of their tokens of both sides."""
        good = np.ones(len(raw), bool)
        for ids, n, lengths, names in ((a, na, self.one_size, self.one_bytes), (b, nb, self.two_size, self.two_bytes)):
            part = np.repeat(np.arange(len(raw)), n)
            good &= np.bincount(part, lengths[ids], len(raw)).astype(np.int64) == size
        kept = np.flatnonzero(good)
        want = np.frombuffer(b"".join([raw[i] for i in kept.tolist()]), np.uint8)
        owner = np.repeat(kept, size[kept])
        for ids, n, names in ((a, na, self.one_bytes), (b, nb, self.two_bytes)):
            have = np.frombuffer(b"".join(map(names.__getitem__, ids[np.repeat(good, n)].tolist())), np.uint8)
            if (wrong := have != want).any():
                good[owner[wrong]] = False
                return self._faithful_rest(a, na, b, nb, raw, good)
        return good

    def _faithful_rest(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, raw: list[bytes], good: np.ndarray) -> np.ndarray:
        """The same, part by part."""
        for ids, n, names in ((a, na, self.one_bytes), (b, nb, self.two_bytes)):
            cuts = np.cumsum(n)
            for i in np.flatnonzero(good).tolist():
                good[i] = b"".join(map(names.__getitem__, ids[cuts[i] - n[i] : cuts[i]].tolist())) == raw[i]
        return good

    def _names(self, a: np.ndarray, b: np.ndarray, one_ends: np.ndarray, two_ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as text, ``;`` after each, and where each one ends."""
        bar, comma = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        bar[one_ends - 1], comma[two_ends - 1] = 1, 1
        codes = np.empty(len(a) + len(b), np.int64)
        # tokens of A come behind the tokens of B of all groups before, those of B behind the tokens of A up to their own group
        one = np.arange(len(a)) + np.repeat(np.concatenate([[0], two_ends])[:-1], np.diff(one_ends, prepend=0))
        two = np.arange(len(b)) + np.repeat(one_ends, np.diff(two_ends, prepend=0))
        codes[one], codes[two] = 2 * a + bar, 2 * (len(self.one_bytes) + b) + comma
        ends = np.cumsum(self.name_size[codes])
        return b"".join(map(self.names.__getitem__, codes.tolist())), ends[one_ends + two_ends - 1]

    def parts(self, s: pieces.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of a slice in the store, and the bounds of each text's."""
        starts = self.cut(s)
        rows = pieces.named(s, starts, np.append(starts[1:], len(s.codes)), self.store, self._make)
        return rows, np.searchsorted(starts, s.bounds, "left")

    def facts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part: tokens of A and of B, groups, links."""
        at = self.store.made.start[rows]
        flat = self.store.made.flat
        return np.stack([flat[at], flat[at + 1], flat[at + 2], self.store.made.length[rows] - 3])

    def links(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of the parts, joined, and how many each one has."""
        sizes = self.store.made.length[rows].astype(np.int64) - 3
        return self.store.made.flat[pieces.spread(self.store.made.start[rows] + 3, sizes)], sizes


_aligners: dict[tuple[str, str], Aligner] = {}
common.KEPT["alignment"] = _aligners.clear


def aligner(byte_path: str, piece_path: str) -> Aligner:
    if (byte_path, piece_path) not in _aligners:
        _aligners.clear()
        _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _aligners[byte_path, piece_path]


def _spaced(column: pa.Array) -> pa.Array:
    """A space before every text that is not empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))


class Texts:
    """Whole texts of a batch, as their parts; a long one's come together again."""

    def __init__(self, column: pa.Array, a: Aligner):
        self.column, self.a = column, a

    def __iter__(self) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]], bool]]:
        """Rows i to j, the parts of a slice and their bounds, and whether their texts end with it."""
        for i, j, s in pieces.slices(_spaced(self.column)):
            rows, bounds = self.a.parts(s)
            yield i, j, rows, bounds, s.last


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def count_pairs(docs: DataFrame, byte_path: str, piece_path: str, text: str) -> DataFrame:
    """Of each linked id pair, the documents that hold it: h1 (the pair, mixed), h2 (the pair), n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("alignment")
        a, counter = aligner(byte_path, piece_path), lookups.Counter()

        def counted(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            return counter.add(common.mix64(pairs.view(np.uint64)), pairs, n)

        for batch in batches:
            waiting, whole = [], True
            for _, _, rows, bounds, last in Texts(batch.column(text), a):
                na = a.facts(rows)[0] if len(rows) else rows
                bad = _per_text(na == 0, bounds) > 0
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                if waiting or not last:  # one long text
                    whole &= not bad.any()
                    waiting.append(np.unique(a.links(np.unique(rows))[0]))
                    if last:
                        pairs = np.unique(np.concatenate(waiting))
                        if whole:
                            yield from counted(pairs, np.ones(len(pairs), np.int64))
                        waiting, whole = [], True
                    continue
                rows, doc = rows[~bad[doc]], doc[~bad[doc]]
                if not len(rows):
                    continue
                # distinct parts of each text, then distinct pairs of each text
                key = np.unique((doc << 32) | rows)
                links, sizes = a.links(key & 0xFFFFFFFF)
                pairs, inverse = np.unique(links, return_inverse=True)
                held = np.unique((np.repeat(key >> 32, sizes) * len(pairs)) + inverse)
                yield from counted(pairs, np.bincount(held % len(pairs), minlength=len(pairs)))
        yield from counter.flush()

    return lookups.summed(docs.select(text).mapInArrow(run, lookups.COUNTED))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, r long, rare binary"


class Row:
    """What gathers of one text."""

    def __init__(self):
        self.facts = np.zeros(6, np.int64)
        self.good, self.digest = True, None
        self.rare: list[np.ndarray] = []

    def done(self) -> tuple:
        if not self.good or self.digest is None:
            return (0, 0, 0, 0, 0, 0, "", b"")
        pairs, m = np.unique(np.concatenate(self.rare), return_counts=True) if self.rare else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return (*self.facts.tolist(), self.digest.hexdigest(), lookups.packed(common.mix64(pairs.view(np.uint64)), pairs, m))


def _rows(docs: DataFrame, byte_path: str, piece_path: str, key: str, text: str, known: tuple[np.ndarray, np.ndarray], highest: np.ndarray) -> DataFrame:
    """One row a text: sums over the known pairs, and the rest as a packed list."""
    pairs, n = known

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("alignment")
        a, numbers = aligner(byte_path, piece_path), lookups.Rows()
        mixed = common.mix64(pairs.view(np.uint64))
        order = np.argsort(mixed)
        table, count = lookups.Table(mixed[order]), n[order]
        best = count == highest[pairs[order] >> 32]
        for batch in batches:
            out: list[tuple] = []
            row = Row()
            for _, _, rows, bounds, last in Texts(batch.column(text), a):
                distinct, back = np.unique(rows, return_inverse=True)
                links, sizes = a.links(distinct)
                at = table.find(common.mix64(links.view(np.uint64)))
                where = np.repeat(np.arange(len(distinct)), sizes)
                hit = at >= 0
                summed = lambda v: np.bincount(where[hit], v[at[hit]], len(distinct)).astype(np.int64)  # noqa: E731, B023
                exact = np.zeros(len(distinct), np.int64)
                np.add.at(exact, where[hit], count[at[hit]])
                values = np.concatenate([a.facts(distinct), [summed(best), exact]]) if len(distinct) else np.zeros((6, 0), np.int64)
                per_text = np.stack([_per_text(v[back], bounds) for v in values], 1)
                bad = _per_text(values[0][back] == 0, bounds) > 0
                misses = links[~hit]
                miss_ends = np.concatenate([[0], np.cumsum(np.bincount(where[~hit], minlength=len(distinct)))])
                has_miss = (np.diff(miss_ends) > 0)[back]
                for k, (lo, hi) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                    row.good &= not bad[k]
                    row.facts += per_text[k]
                    if hi > lo:
                        joined = b"".join(map(a.store.groups.__getitem__, rows[lo:hi].tolist()))
                        if row.digest is None:
                            row.digest = hashlib.sha256(joined[:-1])
                        else:
                            row.digest.update(b";" + joined[:-1])
                        rare = back[lo:hi][has_miss[lo:hi]]
                        if len(rare):
                            row.rare.append(misses[pieces.spread(miss_ends[rare], miss_ends[rare + 1] - miss_ends[rare])])
                    if last or k < len(bounds) - 2:
                        out.append(row.done())
                        row = Row()
            kinds_ = [*[pa.int64()] * 6, pa.string(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_, strict=True)] if out else [pa.array([], t) for t in kinds_]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), *columns[:7], pa.array(numbers.take(len(out))), columns[7]], names=[c.split()[0] for c in SCORED.split(", ")])

    return docs.select(key, text).mapInArrow(run, SCORED)


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", known: int = KNOWN) -> DataFrame:
    """Tokens, groups and links of every row, and how common its links are in the whole table."""
    pairs = count_pairs(docs, byte_path, piece_path, text)
    one = F.shiftright("h2", 32)
    top = lookups.frequent(pairs, known).select("h2", "n").toArrow()  # ``known`` rows at most
    best = pairs.groupBy(one.cast("int").alias("a")).agg(F.max("n").alias("most")).toArrow()  # one row for each id of the vocabulary
    highest = np.zeros(1 + max(best.column("a").to_pylist(), default=0), np.int64)
    highest[best.column("a").to_numpy()] = best.column("most").to_numpy()
    rows = common.durable(_rows(docs, byte_path, piece_path, key, text, (top.column("h2").to_numpy(), top.column("n").to_numpy()), highest))
    most = best.num_rows and docs.sparkSession.createDataFrame(best)
    judged = pairs.join(F.broadcast(most), one == F.col("a")).select("h1", "h2", "n", (F.col("n") == F.col("most")).alias("best")) if most else pairs.withColumn("best", F.lit(False))
    found = lookups.resolved(rows, judged, more_best=F.when(F.col("best"), F.col("m")).otherwise(0), more=F.col("m") * F.col("n"))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).cast("long").alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).cast("long").alias("count_sum"), "groups_sha256"
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
