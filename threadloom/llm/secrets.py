"""Secret scans: fixed patterns, and a battery of randomness tests on other tokens.

Tokens are runs of 20 or more characters of ``A-Za-z0-9+/_=-``. Each is read
in its inferred encoding (decimal, hex, letters of one case, base32, lower- or
upper-case base36, base62, base64, URL base64), and three statistics are taken of it: chi-squared
of its symbols against a uniform alphabet, runs (of symbols above and below the
alphabet's middle, and of character classes), and lag-one serial correlation.

Each statistic is held against two hypotheses. Under randomness a token that
one of them rejects at a Bonferroni share of ``reject`` is no secret. Under
ordinary text (letters drawn as in words, few changes of class) it gives the
chance that text looks as random as this token does, and the three chances
combine by Brown's method, with weights and an allowance for their dependence. Those combined
p-values of one document are a family; Benjamini-Hochberg with weights that
grow with token length controls the false discoveries among its tokens.

Defined cases: a null text is empty and has no secret; tokens of digits alone
are no secrets, whatever their length; letters of one case alone may be
run-together words, so their p-value is bounded below, by less the longer they
are; very long runs are tested whole; repeated rows give repeated rows; other columns are ignored, or
kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24, "random": 20}
Span = tuple[str, int, int]

_LETTERS = {"digit": "0123456789", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Alphabets from the narrowest to the widest: the first that holds all of a token's characters is its encoding.
ALPHABETS = {
    "decimal": _LETTERS["digit"],
    "hex": _LETTERS["digit"] + "abcdef",
    "HEX": _LETTERS["digit"] + "ABCDEF",
    "lower": _LETTERS["lower"],
    "upper": _LETTERS["upper"],
    "base32": _LETTERS["upper"] + "234567",
    "base36": _LETTERS["digit"] + _LETTERS["lower"],
    "BASE36": _LETTERS["digit"] + _LETTERS["upper"],
    "base62": _LETTERS["upper"] + _LETTERS["lower"] + _LETTERS["digit"],
    "base64": _LETTERS["upper"] + _LETTERS["lower"] + _LETTERS["digit"] + "+/",
    "base64url": _LETTERS["upper"] + _LETTERS["lower"] + _LETTERS["digit"] + "-_",
    "mixed": _LETTERS["upper"] + _LETTERS["lower"] + _LETTERS["digit"] + "+/-_",
}
#: Letters per thousand in running text of the four languages, a to z.
_TEXT = (82, 15, 32, 42, 145, 14, 18, 30, 76, 4, 6, 48, 27, 79, 69, 23, 6, 67, 71, 76, 36, 12, 13, 3, 9, 5)


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_TOKEN = _table(ALPHABETS["mixed"] + "=")
_HEX = _table("0123456789abcdef")
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and end of the longest runs of a byte class, ``least`` or longer, inside one text."""
    inside = member[data].astype(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    # a run that crosses texts is cut at their borders
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    first, last = np.searchsorted(offsets, starts, "right") - 1, np.searchsorted(offsets, ends, "left") - 1
    out = []
    for s, e, a, b in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
        for doc in range(a, b + 1):
            lo, hi = max(s, int(offsets[doc])), min(e, int(offsets[doc + 1]))
            if hi - lo >= least:
                out.append((doc, lo, hi))
    found = np.asarray(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, dof: int) -> float:
    """Wilson-Hilferty approximation of the upper tail."""
    c = 2 / (9 * dof)
    return normal_tail(((max(x, 0.0) / dof) ** (1 / 3) - (1 - c)) / math.sqrt(c))


def log_poisson_tail(k: int, mean: float) -> float:
    """Logarithm of the chance of k or more events: a series of ratios on the side of k that is the smaller."""
    if k <= 0:
        return 0.0
    above = k > mean
    at = k if above else k - 1
    term, total, j = 1.0, 1.0, at
    while term > 1e-17 * total:
        if above:
            j += 1
            term *= mean / j
        else:
            term *= j / mean
            j -= 1
        total += term
    log = at * math.log(mean) - mean - math.lgamma(at + 1) + math.log(total)
    return min(0.0, log) if above else math.log1p(-min(math.exp(log), 1 - 1e-16))


def encoding(token: str) -> str:
    chars = set(token)
    return next((k for k, v in _SETS.items() if chars <= v), "mixed")


def log_gamma_tail(x: float, dof: float) -> float:
    """Logarithm of the chance that chi-squared exceeds x: a continued fraction, or a series for small x."""
    a, y = dof / 2, x / 2
    if y <= 0:
        return 0.0
    front = a * math.log(y) - y - math.lgamma(a)
    if y < a + 1:
        term = total = 1 / a
        k = a
        while term > 1e-16 * total:
            k += 1
            term *= y / k
            total += term
        return math.log1p(-min(math.exp(front + math.log(total)), 1 - 1e-16))
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return min(0.0, front + math.log(h))


def log_normal_tail(z: float) -> float:
    """Logarithm of the upper tail, by its asymptotic form where the tail is too small for a float."""
    return math.log(normal_tail(z)) if z < 30 else -z * z / 2 - math.log(z * math.sqrt(2 * math.pi))


#: Weights of the three statistics (neighbours in words tell the least), and the correlation that Brown's method allows for.
WEIGHTS, DEPENDENT = (1.0, 1.0, 0.2), 0.1


def combined(logs: list[float]) -> float:
    """Logarithm of the combined p-value of weighted, dependent ones."""
    mean, square = 2 * sum(WEIGHTS), sum(w * w for w in WEIGHTS)
    var = 4 * square + (sum(WEIGHTS) ** 2 - square) * DEPENDENT * (3.25 + 0.75 * DEPENDENT)
    total = -2 * sum(w * x for w, x in zip(WEIGHTS, logs, strict=True))
    return log_gamma_tail(total * 2 * mean / var, 2 * mean * mean / var)


def battery(token: str) -> tuple[str, tuple[float, float, float], float]:
    """Encoding, p-values of the three tests of randomness, and the combined p-value of the same statistics under ordinary text."""
    body = token.rstrip("=").replace("=", "")
    name = encoding(body)
    alphabet = ALPHABETS[name]
    n, m = len(body), len(alphabet)
    if n < 2:
        return name, (0.0, 0.0, 0.0), 1.0
    place = {c: i for i, c in enumerate(alphabet)}
    codes = np.fromiter(map(place.__getitem__, body), np.int64, n)
    counts = np.bincount(codes, minlength=m)
    chi2 = float(((counts - n / m) ** 2).sum() * m / n)
    # for few symbols a cell the statistic is spread a little less than chi-squared
    p_chi = chi2_tail((chi2 - (m - 1)) / math.sqrt(max(1e-9, 1 - 1 / n)) + (m - 1), m - 1)
    high = codes >= m / 2
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        mean = 1 + 2 * ups * downs / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = 2 * normal_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    x = codes - (m - 1) / 2
    r = float((x[1:] * x[:-1]).sum()) / ((m * m - 1) / 12)
    p_serial = 2 * normal_tail(abs(r) / math.sqrt(n - 1))
    return name, (p_chi, p_runs, p_serial), against_text(chi2, r, alphabet, body)


def against_text(chi2: float, r: float, alphabet: str, body: str) -> float:
    """Chance that characters drawn as in words look as random: by uniformity, by runs of classes, by serial correlation."""
    n, m = len(body), len(alphabet)
    q = np.zeros(m)
    for c, w in zip(_LETTERS["lower"], _TEXT, strict=True):
        at = [i for i in (alphabet.find(c), alphabet.find(c.upper())) if i >= 0]
        for i in at:  # words are lower case with a capital now and then, or upper case throughout
            q[i] += w * ((0.95 if alphabet[i].islower() else 0.05) if len(at) == 2 else 1.0)
    if not q.any():  # digits alone: ordinary numbers are short and round; none is called a secret
        return 1.0
    q = q / q.sum() * 0.98 + 0.02 / m
    mean = m * float((q * (1 - q)).sum()) + n * m * float(((q - 1 / m) ** 2).sum())
    third, second = float((q**3).sum()), float((q**2).sum())
    sd = m * math.sqrt(max(1e-9, 2 * second**2 + 4 * n * (third - second**2)))
    log_close = log_normal_tail((mean - chi2) / sd)
    if body.isalpha() and (body.islower() or body.isupper()):
        return max(math.exp(log_close), 10 ** -(3 + max(0, n - 20) / 16))
    # classes: lower case (a capital begins a word), digits; ordinary names change class once in twelve characters
    kinds = np.frombuffer(body.encode(), np.uint8)
    digit, lower = (kinds >= 0x30) & (kinds <= 0x39), (kinds >= 0x61) & (kinds <= 0x7A)
    upper = (kinds >= 0x41) & (kinds <= 0x5A)
    changes = int(((digit[1:] != digit[:-1]) | (lower[:-1] & upper[1:])).sum())
    log_runs = log_poisson_tail(changes, n / 12)
    # neighbours of words lie on one side of the alphabet's middle together
    place = (np.arange(m) - (m - 1) / 2) / math.sqrt((m * m - 1) / 12)
    one, two = float((q * place).sum()), float((q * place**2).sum())
    spread = (n - 1) * (two * two - one**4) + 2 * max(0, n - 2) * one * one * (two - one * one)
    log_serial = log_normal_tail((one * one * (n - 1) - r) / math.sqrt(max(1e-9, spread)))
    return math.exp(combined([log_close, log_runs, log_serial]))


@dataclass(frozen=True)
class Battery:
    """reject: share of random tokens that the tests may turn away; q: false-discovery share."""

    reject: float = 1e-4
    q: float = 1e-4

    def chosen(self, tokens: list[str]) -> list[bool]:
        made = [battery(t) for t in tokens]
        weight = [math.log2(len(t)) - math.log2(LEAST["random"] / 2) for t in tokens]
        scale = len(weight) / sum(weight) if weight else 1.0
        p = [min(1.0, m[2] / (w * scale)) for m, w in zip(made, weight, strict=True)]
        order = sorted(range(len(p)), key=p.__getitem__)
        last = max((k + 1 for k, i in enumerate(order) if p[i] <= self.q * (k + 1) / len(p)), default=0)
        found = set(order[:last])
        return [i in found and min(made[i][1]) >= self.reject / 3 for i in range(len(tokens))]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns but hex, in code points."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return found + [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]


def free(tokens: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """Tokens, in order and apart from each other, that no span overlaps."""
    ends = sorted((s, e) for _, s, e in spans)
    starts, reach, out = [s for s, _ in ends], [], []
    for _, e in ends:
        reach.append(max(e, reach[-1] if reach else 0))
    for a, b in tokens:
        k = bisect_left(starts, b)  # spans that begin before the token ends
        if not k or reach[k - 1] <= a:
            out.append((a, b))
    return out


def scan(data: np.ndarray, offsets: np.ndarray, method: Battery) -> Iterator[list[Span]]:
    """Spans of each text: base ones and those the method adds, by start, then kind."""
    n = len(offsets) - 1
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    seen = data.tobytes()
    hexes: dict[int, list[tuple[int, int]]] = {}
    tokens: dict[int, list[tuple[int, int]]] = {}
    for member, least, into in ((_HEX, LEAST["hex"], hexes), (_TOKEN, LEAST["random"], tokens)):
        for doc, a, b in zip(*(x.tolist() for x in runs(data, offsets, member, least)), strict=True):
            into.setdefault(doc, []).append((a, b))
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 0x3A) | (data == 0x3D), out=marks[1:])
    assigned = np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])
    keyed = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in re.finditer(b"AKIA", seen)}
    busy = keyed | set(assigned.tolist()) | set(hexes) | set(tokens)
    for doc in range(n):
        if doc not in busy:
            yield []
            continue
        lo, hi = int(offsets[doc]), int(offsets[doc + 1])
        raw = seen[lo:hi]
        text = raw.decode("utf-8", "replace")
        at = lambda b: b - lo  # noqa: B023, E731
        if len(text) != len(raw):  # code points before each byte
            before = np.zeros(hi - lo + 1, np.int64)
            np.cumsum((data[lo:hi] & 0xC0) != 0x80, out=before[1:])
            at = lambda b: int(before[b - lo])  # noqa: B023, E731
        spans = base_spans(text)
        spans += [("hex", at(a), at(b)) for a, b in hexes.get(doc, ())]
        rest = free([(at(a), at(b)) for a, b in tokens.get(doc, ())], spans)
        words = [text[a:b] for a, b in rest]
        spans += [("random", a, b) for (a, b), yes in zip(rest, method.chosen(words), strict=True) if yes]
        yield sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, method: Battery = Battery(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and spans of every whole text, in one pass without a shuffle."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("secrets")
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(text))
            rows = []
            for i, j in common.slices(offsets):
                for spans in scan(data, offsets[i : j + 1], method):
                    count = {k: sum(s[0] == k for s in spans) for k in KINDS}
                    digest = hashlib.sha256(joined([s for s in spans if s[0] != "random"]).encode()).hexdigest()
                    rows.append((count["assign"], count["access"], count["hex"], digest, joined(spans), count["random"]))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()])]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), *columns], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(key, text).mapInArrow(run, schema)


def redact(docs: DataFrame, method: Battery = Battery(), mask: str = "[secret]", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows with every secret replaced by the mask, and the length column set anew where a text changed."""
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("secrets")
        for batch in batches:
            at = batch.schema.get_field_index(text)
            data, offsets = common.text_buffers(batch.column(at))
            values = {}
            for i, j in common.slices(offsets):
                for k, spans in enumerate(scan(data, offsets[i : j + 1], method), i):
                    if spans:
                        whole = batch.column(at)[k].as_py()
                        parts, done = [], 0
                        for _, a, b in spans:
                            if b <= done:
                                continue
                            if a >= done:
                                parts += [whole[done:a], mask]
                            done = b
                        values[k] = "".join([*parts, whole[done:]])
            if values:
                new = batch.column(at).to_pylist()
                for k, v in values.items():
                    new[k] = v
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
                if length and (li := batch.schema.get_field_index(length)) >= 0:
                    sizes = batch.column(li).to_pylist()
                    for k, v in values.items():
                        sizes[k] = len(v)
                    batch = batch.set_column(li, batch.schema.field(li), pa.array(sizes, batch.schema.field(li).type))
            yield batch

    return docs.mapInArrow(run, schema)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.read(spark, sf_dir, "documents"))
