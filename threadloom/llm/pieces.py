"""Texts cut into a tokenizer's pieces, many at a time, and what is remembered of distinct pieces.

A run of texts becomes one array of code points. Each code point has a kind;
borders between kinds, texts and special strings give the pieces, by array
operations alone. Pieces are looked up by 64-bit hashes of their code points in
a bounded ``Store`` that holds what was made of each distinct one, so the slow
work is done once for a piece and gathered for all its occurrences. A hash only
says where to look: each piece is compared with the code points that it is
taken for, and one of equal hash but other code points is worked out by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from . import common

SPACE, OTHER_SPACE, LETTER, DIGIT, MARK, ODD, SPECIAL = range(7)
#: Bytes of text taken up at a time; longer texts are cut at spaces.
SLICE = 1 << 19
#: Endings that an apostrophe forms a piece with.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def _code_hashes() -> np.ndarray:
    return common.seeds(0x110000, 11)


class Slice:
    """The code points of some texts. ``bounds``: of each text its first one; one more at the end.
    ``last``: no part of the same text follows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, last: bool = True):
        self.last = last
        raw = data[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        if len(raw) and raw.max() >= 0x80:
            lead = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
            self.text = raw.tobytes().decode()
            self.codes, self.bounds = np.frombuffer(self.text.encode("utf-32-le"), np.uint32), lead[at]
        else:
            self.text = raw.tobytes().decode("ascii")
            self.codes, self.bounds = raw, at

    @classmethod
    def of(cls, text: str) -> Slice:
        raw = np.frombuffer(text.encode(), np.uint8)
        return cls(raw, np.asarray([0, len(raw)]))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        return common.span_hash(_code_hashes()[self.codes if codes is None else codes], starts, ends)

    def endings(self, apostrophes: np.ndarray, kinds: np.ndarray, border: np.ndarray, fold: bool) -> np.ndarray:
        """Of each apostrophe: letters of the ending that follows it inside one text, or zero."""
        n = len(self.codes)
        found = np.zeros(len(apostrophes), np.int64)
        for ending in ENDINGS:
            fits = apostrophes + len(ending) < n
            for k, c in enumerate(ending, 1):
                at = np.minimum(apostrophes + k, n - 1)
                same = self.codes[at] == ord(c)
                if fold:
                    same |= self.codes[at] == ord(c.upper())
                fits &= same & ~border[at] & (kinds[at] == LETTER)
            found[fits] = len(ending)
        return found


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, Slice]]:
    """Rows i to j of a string column as one ``Slice``; a long text comes in parts (i, i + 1), each
    beginning with a space between two characters that are not white."""
    data, offsets = common.text_buffers(column)
    for i, j in common.slices(offsets, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        while hi - lo > 2 * limit:  # one long text
            cut = _gap(data, lo + limit, hi)
            if cut is None:
                break
            yield i, j, Slice(data, np.asarray([lo, cut]), last=False)
            lo = cut
        yield i, j, Slice(data, np.asarray([lo, hi]) if j == i + 1 else offsets[i : j + 1])


def _gap(data: np.ndarray, start: int, end: int) -> int | None:
    """The first space from ``start`` on between two printable ASCII characters."""
    while start < end - 1:
        part = data[start - 1 : min(start + (1 << 16), end)]
        solid = (part > 0x20) & (part < 0x7F)
        at = np.flatnonzero((part[1:-1] == 0x20) & solid[:-2] & solid[2:])
        if len(at):
            return start + int(at[0])
        start += len(part) - 2
    return None


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all the spans, joined."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def spans_equal(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_starts: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Which spans hold the same code points as their counterparts."""
    same = sizes == other_sizes
    at = np.flatnonzero(same)
    differs = codes[spread(starts[at], sizes[at])] != others[spread(other_starts[at], sizes[at])]
    if differs.any():
        same[np.repeat(at, sizes[at])[differs]] = False
    return same


class Flat:
    """Arrays of different sizes, one after the other."""

    def __init__(self, kind: str):
        self.count = self.used = 0
        self.flat = np.zeros(1 << 16, kind)
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        first, used = self.count, self.used
        self.count, self.used = first + len(sizes), used + len(flat)
        for name, need in (("flat", self.used), ("start", self.count), ("length", self.count)):
            have = getattr(self, name)
            if need > len(have):
                more = np.zeros(max(need, 2 * len(have)), have.dtype)
                more[: len(have)] = have
                setattr(self, name, more)
        self.flat[used : self.used] = flat
        self.start[first : self.count] = used + np.cumsum(sizes) - sizes
        self.length[first : self.count] = sizes


class Store:
    """Arrays remembered by a piece's code points, in a table of open addresses by hash.

    All are dropped when there are more than ``most`` of them, or more than
    32 values or code points of each on average.
    """

    def __init__(self, most: int, kind: str):
        self.most, self.kind = most, kind
        self._clear()

    def _clear(self) -> None:
        self.made, self.codes = Flat(self.kind), Flat("<u4")
        self.entered = 0
        self._table(1 << 14)

    def _table(self, size: int) -> None:
        self.keys, self.at = np.zeros(size, np.uint64), np.zeros(size, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash's array, or -1."""
        found = np.full(len(hashes), -1, np.int64)
        todo, mask = np.arange(len(hashes)), np.uint64(len(self.keys) - 1)
        slot = hashes & mask
        while len(todo):
            key = self.keys[slot]
            hit = key == hashes[todo]
            found[todo[hit]] = self.at[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & mask
        return found

    def _enter(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Distinct hashes that are not in the table."""
        mask = np.uint64(len(self.keys) - 1)
        slot = hashes & mask
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]  # of several on one place the last one stays
            won = self.keys[slot] == hashes
            self.at[slot[won]] = rows[won]
            hashes, rows, slot = hashes[~won], rows[~won], (slot[~won] + np.uint64(1)) & mask

    def rows(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Numbers of the pieces' arrays. ``make`` gives the arrays at the places that are not known: joined, and their sizes.

        The hashes are distinct; pieces beyond them share the hash of another
        one here, and get arrays that are not entered in the table.
        """
        hashes, n = np.maximum(hashes, np.uint64(1)), len(hashes)  # zero marks a free place
        got = np.full(len(starts), -1, np.int64)
        got[:n] = self.find(hashes)
        known = np.flatnonzero(got >= 0)
        held = got[known]
        taken = known[~spans_equal(codes, starts[known], sizes[known], self.codes.flat, self.codes.start[held], self.codes.length[held])]
        got[taken] = -1
        new = np.flatnonzero(got < 0)
        if len(new) and (self.made.count + len(new) > self.most or max(self.made.used, self.codes.used) > 32 * self.most):
            self._clear()
            taken, new = taken[:0], np.arange(len(starts))
        if len(new):
            first = self.made.count
            self.made.add(*make(new))
            self.codes.add(codes[spread(starts[new], sizes[new])], sizes[new])
            got[new] = np.arange(first, self.made.count)
            enter = np.setdiff1d(new[new < n], taken)
            self.entered += len(enter)
            if 2 * self.entered > len(self.keys):
                full = self.keys != 0
                keys, at = self.keys[full], self.at[full]
                self._table(1 << (4 * self.entered - 1).bit_length())
                self._enter(keys, at)
            self._enter(hashes[enter], got[enter])
        return got

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers, joined, and the bounds of each."""
        sizes = self.made.length[rows]
        ends = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        return self.made.flat[spread(self.made.start[rows], sizes)], ends

    def last(self, rows: np.ndarray) -> np.ndarray:
        """The last value of each array."""
        return self.made.flat[self.made.start[rows] + self.made.length[rows] - 1]


def named(s: Slice, starts: np.ndarray, ends: np.ndarray, store: Store, make: Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]], codes: np.ndarray | None = None) -> np.ndarray:
    """Of each piece the number of its array in the store. ``make`` gets texts, and the numbers of the pieces they are.

    codes: in place of the slice's own, where different characters count as one.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    codes = s.codes if codes is None else codes
    distinct, first, inverse = np.unique(s.hashes(starts, ends, codes), return_index=True, return_inverse=True)
    sizes, stand = ends - starts, first[inverse]
    odd = np.flatnonzero(~spans_equal(codes, starts, sizes, codes, starts[stand], sizes[stand]))
    if len(odd):
        inverse[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])

    def texts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = first[places]
        return make([s.text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], at)

    return store.rows(distinct, codes, starts[first], sizes[first], texts)[inverse]
