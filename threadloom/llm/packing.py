"""Vector bin packing of token sequences by the dot-product heuristic.

An example demands a vector: tokens, one segment, loss-bearing tokens. A
sequence has a capacity in each. The open sequence takes, again and again, the
waiting example whose demand has the largest weighted dot product with what
the sequence has left. Where cutting is allowed, the best example that is too
long fills the sequence exactly and its rest waits on. What is left at the end
of a partition is cut into sequences whose lengths are powers of two, which
need no padding. Each partition packs its own rows while it streams them, so
nothing is shuffled and memory holds a bounded number of waiting examples.

Defined cases: a null text is empty and has the end mark only; an empty table
gives no row; repeated rows are packed as often as they occur; other columns
of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common, pieces

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Capacity of a sequence; waiting: examples that a partition keeps back to choose from."""

    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096
    waiting: int = 256


class Packer:
    """Places examples of one partition. ``emit`` gets (example, start, length, sequence, offset)."""

    def __init__(self, limits: Limits, first: int, emit: Callable[[int, int, int, int, int], None], cut: bool = True):
        self.limits, self.emit, self.cut = limits, emit, cut
        self.sequence = first
        n = limits.waiting
        self.left = np.zeros(n, np.int64)  # tokens not placed; 0: a free place
        self.loss = np.zeros(n, np.int64)  # loss-bearing tokens not placed
        self.item = np.zeros(n, np.int64)
        self.start = np.zeros(n, np.int64)
        self.free = list(range(n))
        self._open()

    def _open(self) -> None:
        self.room = [self.limits.tokens, self.limits.segments, self.limits.loss]
        self.used = 0

    def _close(self) -> None:
        if self.used:
            self.sequence += 1
        self._open()

    def _place(self, item: int, start: int, length: int, loss: int) -> None:
        self.emit(item, start, length, self.sequence, self.used)
        self.used += length
        self.room[0] -= length
        self.room[1] -= 1
        self.room[2] -= loss
        if min(self.room[0], self.room[1]) == 0:
            self._close()

    def add(self, item: int, tokens: int, loss: int) -> None:
        """An example, whose last ``loss`` tokens bear loss; a cut takes them from the front."""
        start, bare = 0, tokens - loss
        if self.cut:
            most = self.limits.tokens
            while tokens - start > most and self.used == 0 and (bearing := max(0, start + most - max(start, bare))) <= self.limits.loss:
                self._place(item, start, most, bearing)
                start += most
        elif tokens > self.limits.tokens or loss > self.limits.loss:
            raise ValueError(f"an example of {tokens} tokens, {loss} with loss, exceeds the limits and may not be cut")
        while not self.free:
            self._step()
        k = self.free.pop()
        self.item[k], self.start[k], self.left[k], self.loss[k] = item, start, tokens - start, min(loss, tokens - start)

    def _step(self) -> None:
        """Put the best waiting example, or a part of it, in the open sequence."""
        tokens, segments, loss = self.room
        cap = self.limits
        # demand times what is left, each in units of the capacity; the segment term is equal for all
        score = self.left * (tokens / cap.tokens**2) + self.loss * (loss / cap.loss**2)
        fits = (self.left > 0) & (self.left <= tokens) & (self.loss <= loss)
        if fits.any():
            k = int(np.argmax(np.where(fits, score, -1.0)))
            length, bearing = int(self.left[k]), int(self.loss[k])
        elif self.cut and tokens and loss:
            k = int(np.argmax(np.where(self.left > 0, score, -1.0)))
            whole, bare = int(self.left[k]), int(self.left[k] - self.loss[k])
            length = min(whole - 1, tokens, bare + loss)
            if length <= 0:
                return self._close()
            bearing = max(0, length - bare)
        else:
            return self._close()
        self._take(k, length, bearing)

    def _take(self, k: int, length: int, bearing: int) -> None:
        item, start = int(self.item[k]), int(self.start[k])
        self.left[k] -= length
        self.loss[k] -= bearing
        self.start[k] += length
        if self.left[k] == 0:
            self.free.append(k)
        self._place(item, start, length, bearing)

    def flush(self) -> None:
        """Pack all that waits: first full sequences, then powers of two."""
        while self.left.any():
            rest = int(self.left.sum())
            up = 1 << (self.used - 1).bit_length() if self.used else 1 << (rest.bit_length() - 1)
            if not self.cut or self.used + rest >= self.limits.tokens or self.used + rest < up:
                self._step()  # to the full, or the end of all
            else:
                self._fill(up - self.used)
                self._close()
        self._close()

    def _fill(self, length: int) -> None:
        """Fill exactly so many tokens where the other limits allow it, longest examples first, cutting the last."""
        seq = self.sequence
        while length and self.left.any() and self.sequence == seq:
            bare = self.left - self.loss
            fits = np.minimum(np.minimum(self.left, length), bare + self.room[2])
            whole = np.where(fits == self.left, self.left, 0)
            k = int(np.argmax(whole if whole.any() else fits))
            take = int(fits[k])
            if take <= 0:
                return
            self._take(k, take, max(0, take - int(bare[k])))
            length -= take


#: Distinct pieces that a worker remembers.
REMEMBERED = 1_000_000
#: How a vocabulary file must cut texts for its ids to be joined from pieces.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"


@cache
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point, and its lower case. Letters, digits and marks are those below U+0250 that normalizing leaves
    one character of the same kind; the rest is odd, and so are the words that hold it."""

    def kind(c: str) -> int:
        if c in " \t\n\v\f\r":
            return pieces.SPACE
        if not c.isprintable() or c.isspace():
            return pieces.ODD
        return {"L": pieces.LETTER, "N": pieces.DIGIT}.get(unicodedata.category(c)[0], pieces.MARK)

    table, lower = np.full(0x110000, pieces.ODD, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x250):
        low = unicodedata.normalize("NFC", chr(i)).lower()
        if len(low) == 1 and kind(low) == kind(chr(i)):
            table[i], lower[i] = kind(low), ord(low)
    return table, lower


def cut_words(s: pieces.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces: letters, single digits, marks, endings, and words with odd
    characters as a whole; which ones are these; the code points, in lower case outside of these."""
    n = len(s.codes)
    table, lower = kinds()
    kind, codes = table[s.codes], lower[s.codes]
    white = kind == pieces.SPACE
    border = np.zeros(n + 1, bool)
    border[s.bounds] = True
    border = border[:n]
    change = border.copy()
    change[1:] |= kind[1:] != kind[:-1]
    mark = change | (kind == pieces.DIGIT)
    quote = np.flatnonzero(change & (s.codes == 0x27))
    ending = s.endings(quote, kind, border, fold=True)
    quote, ending = quote[ending > 0], ending[ending > 0]
    mark[quote + 1] = False
    mark[(quote + 1 + ending)[quote + 1 + ending < n]] = True
    odd = kind == pieces.ODD
    odd[1:] |= (s.codes[1:] == 0x3E) & (s.codes[:-1] == 0x7C) & ~border[1:]  # "|>" ends a special string
    strange = np.zeros(n, bool)
    if odd.any():
        first = border.copy()
        first[1:] |= white[:-1]
        first &= ~white
        word = np.cumsum(first)
        holds = np.zeros(int(word[-1]) + 1, bool)
        holds[word[odd]] = True
        strange = holds[word] & ~white
        mark = (mark & ~strange) | (first & strange)
        codes[strange] = s.codes[strange]
    edges = np.flatnonzero(mark | (white & change))
    at = np.flatnonzero(mark[edges] & ~white[edges])
    starts = edges[at]
    return starts, np.append(edges, n)[at + 1], strange[starts], codes


class Encoder:
    """Token ids of texts, for a tokenizer that drops white space and marks word ends.

    No token spans two pieces, so a text's ids are those of its pieces. Pieces
    met for the first time are encoded in one call and told apart by their
    end-of-word tokens. A file that cuts texts in another way is refused.
    """

    def __init__(self, path: str, remember: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["normalizer"] or {}).get("normalizers")
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        special = [t["content"] for t in spec["added_tokens"]]
        known = steps == NORMALIZER and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        if not known or spec["model"].get("end_of_word_suffix") != END or not all(t.endswith("|>") and not re.search(r"\s", t) for t in special):
            raise ValueError(f"{path}: not a vocabulary whose normalizer, pieces and word ends this encoder knows")
        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True
        self.store = pieces.Store(remember, "<u4")

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, joined, and how many each one has."""
        made = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.asarray([i for ids in made for i in ids], "<u4"), np.fromiter(map(len, made), np.int64, len(made))

    def _make(self, texts: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces; of those that are whole words, any number of the library's pieces."""
        plain = [t for t, w in zip(texts, whole.tolist(), strict=True) if not w]
        made = []
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids, _ = self._ids([" ".join(part)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            made.append((ids, np.diff(cuts, prepend=0)) if len(cuts) == len(part) else self._ids(part))
        if whole.any():
            made.append(self._ids([t for t, w in zip(texts, whole.tolist(), strict=True) if w]))
        flat, sizes = (np.concatenate(x) for x in zip(*made, strict=True))
        if whole.any():  # back in the order of the texts
            order = np.argsort(whole, kind="stable")
            ends = np.cumsum(sizes)
            back = np.argsort(order)
            flat = np.concatenate([flat[a:b] for a, b in zip((ends - sizes)[back].tolist(), ends[back].tolist(), strict=True)])
            sizes = sizes[back]
        return flat, sizes

    def ids(self, s: pieces.Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slice's texts, joined, and the bounds of each text's."""
        starts, ends, whole, codes = cut_words(s)
        rows = pieces.named(s, starts, ends, self.store, lambda texts, at: self._make(texts, whole[at]), codes)
        ids, at = self.store.gather(rows)
        return ids, at[np.searchsorted(starts, s.bounds, "left")]


_encoders: dict[tuple[str, int], Encoder] = {}
common.KEPT["packing"] = _encoders.clear


def encoder(path: str, remember: int = REMEMBERED) -> Encoder:
    if (path, remember) not in _encoders:
        _encoders.clear()
        _encoders[path, remember] = Encoder(path, remember)
    return _encoders[path, remember]


def encoded(column: pa.Array, coder: Encoder) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows i to j and the ids of each one's whole text, as little-endian 32-bit bytes."""
    parts: list[bytes] = []
    for i, j, s in pieces.slices(column):
        ids, at = coder.ids(s)
        raw, stops = ids.tobytes(), (4 * at).tolist()
        made = [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]
        if j == i + 1:  # a part of a long text, or all of it
            parts += made
            if s.last:
                yield i, j, [b"".join(parts)]
                parts = []
        else:
            yield i, j, made


def pack_documents(docs: DataFrame, tokenizer: str, eos: int = 2, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", prompt: str | None = None) -> DataFrame:
    """Pack every row's tokens. One row per piece.

    prompt: a column whose tokens come before those of the text and bear no
    loss, for instruction data; without it every token bears loss.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("packing")
        coder, end = encoder(tokenizer), np.asarray([eos], "<u4").tobytes()
        task = TaskContext.get()
        out: list[tuple] = []
        held: dict[int, tuple] = {}

        def emit(item: int, start: int, length: int, sequence: int, offset: int) -> None:
            doc, ids, total = held[item]
            out.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, sequence, offset))

        packer = Packer(limits, (task.partitionId() if task else 0) << 40, emit)
        serial = 0
        for batch in batches:
            keys = batch.column(key).to_pylist()
            asked = [x for _, _, part in encoded(batch.column(prompt), coder) for x in part] if prompt else None
            for i, j, coded in encoded(batch.column(text), coder):
                for k, ids in zip(range(i, j), coded, strict=True):
                    before = asked[k] if asked else b""
                    whole = before + ids + end
                    held[serial] = (keys[k], whole, len(whole) // 4)
                    packer.add(serial, len(whole) // 4, (len(whole) - len(before)) // 4)
                    serial += 1
                waiting = set(packer.item[packer.left > 0].tolist())
                held = {k: v for k, v in held.items() if k in waiting}
                if len(out) > 20_000:
                    yield _rows(out)
                    out.clear()
        packer.flush()
        if out:
            yield _rows(out)

    columns = [key, *([prompt] if prompt else []), text]
    return docs.select(*columns).mapInArrow(pack, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
