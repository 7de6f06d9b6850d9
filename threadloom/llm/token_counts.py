"""Exact token counts at every prefix of a text, by prefix dynamic programming.

For byte-pair encoding the last token of a prefix's encoding is the one token
that ends there and may follow the last token of the prefix before it: the
pair must be what the merges make of its joint bytes. So one pass over a
piece's bytes gives, for every prefix, its last token and its count. Texts are
cut into the pieces of the tokenizer's pattern by array operations, a distinct
piece goes through the dynamic program once, and its row of counts serves all
its occurrences. Counts of whole pieces add up; the table of a text joins the
rows to one count at every prefix, and truncation and budgets are look-ups in
it: nothing is encoded again.

Defined cases: a null text is empty and has no tokens; special strings in a
text are one token each, as the library's default has it, and plain text where
a prefix cuts them open; a vocabulary file without a token for every byte, or
with another way to cut texts, is refused; repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common, pieces

#: The kinds of the tokenizer's byte-level pieces, and the endings that are cut open.
LETTERS, DIGITS, WHITE = r"\p{L}", r"\p{N}", r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
OPEN = ("'re", "'ve", "'ll")
#: Distinct pieces that a worker remembers.
REMEMBERED = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain}
    return shown | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


@cache
def kinds() -> np.ndarray:
    """Kind of each code point."""
    table = np.full(0x110000, pieces.MARK, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((LETTERS, pieces.LETTER), (DIGITS, pieces.DIGIT), (WHITE, pieces.OTHER_SPACE)):
        for run in regex.finditer(f"(?:{pattern})+", every):
            table[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
    table[0x20] = pieces.SPACE
    return table


def cut_pieces(s: pieces.Slice, specials: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pieces, special strings among them; starts and ends of the white runs of two or more
    characters that a character follows."""
    n = len(s.codes)
    kind = kinds()[s.codes]
    border = np.zeros(n + 1, bool)
    border[s.bounds] = True
    for a, b in specials:
        kind[a:b] = pieces.SPECIAL
        border[[a, b]] = True
    border = border[:n]
    white = kind <= pieces.OTHER_SPACE
    group = np.where(white, np.uint8(pieces.SPACE), kind)
    mark = border.copy()
    mark[1:] |= group[1:] != group[:-1]
    # the last white character before another one goes with it if it is a space, else alone
    after = np.flatnonzero(mark[1:] & ~border[1:] & white[:-1]) + 1
    ends, first = after[~mark[after - 1]], np.flatnonzero(mark)
    runs = np.stack([first[np.searchsorted(first, ends) - 1], ends], 1)
    mark[after[kind[after - 1] == pieces.SPACE]] = False
    mark[after - 1] = True
    quote = np.flatnonzero(mark & (s.codes == 0x27) & (kind == pieces.MARK))
    ending = s.endings(quote, kind, border, fold=False)
    quote, ending = quote[ending > 0], ending[ending > 0]
    mark[quote + 1] = False
    mark[(quote + 1 + ending)[quote + 1 + ending < n]] = True
    return np.flatnonzero(mark), runs


class PrefixCounter:
    """Counts of one vocabulary; keeps what it has learnt of pieces and pairs."""

    def __init__(self, path: str, remember: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
            raise ValueError(f"{path}: not a byte-level vocabulary with the pattern that this counter knows")
        to_byte = byte_alphabet()
        raw = lambda token: bytes(to_byte[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in reversed(list(enumerate(merges)))}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        if not all(bytes([b]) in tokens for b in range(256)):
            raise ValueError(f"{path}: no token for some byte, so some texts have no count")
        self.longest = max(map(len, tokens))
        self.token = {t: t for t in tokens if len(t) == 1 or self._merged(t) == [t]}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.store = pieces.Store(remember, "<i4")

    def _merged(self, piece: bytes) -> list[bytes]:
        """What the merges make of a short byte string, lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, before: bytes, token: bytes) -> bool:
        pair = (before, token)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[pair] = self._merged(before + token) == [before, token]
        return known

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of the piece's first 0, 1, ... bytes."""
        last, count = [b""], [0]
        token, longest, follows = self.token, self.longest, self._follows
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                t = token.get(piece[start:end])
                if t is not None and (start == 0 or follows(last[start], t)):
                    last.append(t)
                    count.append(count[start] + 1)
                    break
        return count

    def row(self, piece: str) -> list[int]:
        """Token counts of the piece's first 1, 2, ... characters, each taken as the end of a text."""
        raw = piece.encode()
        count = self.prefixes(raw)
        if piece in OPEN:  # cut open, the letter is a piece of its own
            count[2] = 2
        if len(raw) == len(piece):
            return count[1:]
        return [count[k] for k in range(1, len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80]

    def _rows(self, texts: list[str], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = [self.row(t) for t in texts]
        return np.asarray([x for r in made for x in r], np.int32), np.fromiter(map(len, made), np.int64, len(made))

    def _specials(self, s: pieces.Slice) -> list[tuple[int, int]]:
        if not self.special or not self.special.search(s.text):
            return []
        found = []
        for a, b in zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True):
            found += [m.span() for m in self.special.finditer(s.text, a, b)]
        return found

    def _known(self, s: pieces.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray]:
        """Starts of the pieces, their rows in the store, their counts, the special strings, the white runs' ends."""
        specials = self._specials(s)
        starts, runs = cut_pieces(s, specials)
        rows = pieces.named(s, starts, np.append(starts[1:], len(s.codes)), self.store, self._rows)
        counts = self.store.last(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        counts[np.searchsorted(starts, np.asarray([a for a, _ in specials], np.int64))] = 1
        return starts, rows, counts, specials, runs

    def counts(self, s: pieces.Slice) -> np.ndarray:
        """Tokens of each text of a slice."""
        starts, _, counts, _, _ = self._known(s)
        total = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(total[np.searchsorted(starts, s.bounds, "left")])

    def count(self, text: str) -> int:
        return int(self.counts(pieces.Slice.of(text)).sum())

    def table(self, text: str) -> np.ndarray:
        """Tokens of the text's first 0, 1, 2, ... characters, each prefix counted as a text of its own."""
        s = pieces.Slice.of(text)
        out = np.zeros(len(s.codes) + 1, np.int64)
        starts, rows, counts, specials, runs = self._known(s)
        if not len(starts):
            return out
        before = np.cumsum(counts) - counts
        inside, at = self.store.gather(rows)
        out[1:] = inside + np.repeat(before, np.diff(at))
        for a, b in runs.tolist():  # a white run that ends the prefix is one piece
            out[b] = before[np.searchsorted(starts, a)] + self.row(s.text[a:b])[-1]
        closed = {b for _, b in specials}
        for a, b in specials:  # cut open it is plain text, which may go on from the piece before
            k = int(np.searchsorted(starts, a))
            first = k - 1 if k and a not in closed else k
            for end in range(a + 1, b):
                out[end] = before[first] + self.count(s.text[starts[first] : end])
            out[b] = before[k] + 1
        return out

    def count_at(self, table: np.ndarray, length: int) -> int:
        """Tokens of the first ``length`` characters."""
        return int(table[min(max(length, 0), len(table) - 1)])

    def cut(self, table: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens."""
        return int(np.flatnonzero(table <= max(budget, 0))[-1])


_counters: dict[str, PrefixCounter] = {}
common.KEPT["token_counts"] = _counters.clear


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text", tables: bool = False, budgets: tuple[int, ...] = ()) -> DataFrame:
    """Bytes and tokens of every whole text and whether it exceeds the limit. No shuffle.

    tables: also the prefix table, an array ``counts`` of the tokens of the
    first 0, 1, 2, ... characters. budgets: also an array ``cuts`` with the
    characters of the longest prefix within each budget, from the same table.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + ", counts array<int>" * tables + ", cuts array<long>" * bool(budgets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("token_counts")
        dp = counter(tokenizer)
        for batch in batches:
            column = batch.column(text)
            _, offsets = common.text_buffers(column)
            counts = np.zeros(len(column), np.int64)
            for i, j, s in pieces.slices(column):
                counts[i:j] += dp.counts(s)
            columns = [batch.column(key).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            if tables or budgets:
                held: list[list] = []
                cuts: list[list[int]] = []
                for t in column:
                    table = dp.table(t.as_py() or "")
                    held.append(table.tolist() if tables else [])
                    cuts.append([dp.cut(table, b) for b in budgets])
                if tables:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("counts")
                if budgets:
                    columns.append(pa.array(cuts, pa.list_(pa.int64())))
                    names.append("cuts")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, text).mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
