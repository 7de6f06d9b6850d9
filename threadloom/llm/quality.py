"""Quality rules: robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics: log of the mean word
length, and square roots of the shares of symbols, repeated lines and repeated
words, each shrunk towards ordinary text so that short texts do not stand out
by chance. Each (language, source) group gets a minimum-covariance-determinant
estimate: from medians and median deviations as a start, concentration steps
take the ``keep`` share of the group that lies nearest and re-estimate centre
and scatter. A text is rejected if its Mahalanobis distance exceeds the
chi-squared quantile ``1 - alpha``, or if it fails the base rules.

A concentration step is one aggregation: rows are counted and summed by group
and bin of distance, so any group size is reduced on the map side, and the
nearest bins that hold the share are added up. Only vectors are kept and
shuffled, never texts.

Defined cases: a null text has no words and fails the base rules; a null
language or source is a value of its own; groups of fewer than ``least`` rows
are judged by the estimate of their language's rows, and where these are fewer
too, by that of all rows without the word length, which differs by language
(only in a table of fewer than ``least`` rows the base rules judge alone);
repeated rows count as often as they occur; other columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DIMS = 4
#: Least standard deviation of each statistic, added to the scatter.
FLOOR = (0.05, 0.04, 0.12, 0.1)
#: In place of the first one where languages are mixed: no word length stands out.
WIDE = 1e3
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
X = [f"x{i}" for i in range(DIMS)]
GROUP = ["lang", "source"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


def line_counts(w: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word, and those equal to an earlier one."""
    breaks = np.flatnonzero(w.data == 0x0A)
    texts = len(w.offsets) - 1
    starts = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(w.data)]
    doc = np.searchsorted(w.offsets, starts, "right") - 1
    stops = np.minimum(np.append(breaks, len(w.data))[np.searchsorted(breaks, starts)], w.offsets[doc + 1])
    has_word = np.searchsorted(w.starts, starts) < np.searchsorted(w.starts, stops)
    starts, stops, doc = starts[has_word], stops[has_word], doc[has_word]
    with np.errstate(over="ignore"):
        key = common.mix64(common.span_hash(common._BYTE[w.data], starts, stops, raw=w.data) + doc.astype(np.uint64) * _ODD)
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(doc, minlength=texts)
    return lines, lines - np.bincount(doc[first], minlength=texts)


def repeat_counts(w: common.Words, k: int = 5) -> np.ndarray:
    """Of each text: words in k-word windows that it has twice or more."""
    at, hashes = w.windows(w.hashes(), k)
    with np.errstate(over="ignore"):
        key = common.mix64(hashes + w.doc[at].astype(np.uint64) * _ODD)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    depth = np.zeros(len(w.starts) + 1, np.int64)
    depth[at[twice]] += 1
    depth[at[twice] + k] -= 1
    return common.per_text(w, np.cumsum(depth[:-1]) > 0)


def text_stats(w: common.Words) -> dict[str, np.ndarray]:
    def summed(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[w.offsets[1:]] - total[w.offsets[:-1]]

    n = np.diff(w.bounds).astype(np.int64)
    chars = summed(((w.data & 0xC0) != 0x80) & ~common._SPACE[w.data])
    symbols = summed(_SYMBOL[w.data])
    lines, dup = line_counts(w)
    repeat = repeat_counts(w)
    out = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
    out["base_failed"] = (n < 10) | (100 * repeat > 20 * n)
    vector = (np.log((chars + 250.0) / (n + 50.0)), np.sqrt(symbols / (chars + 50.0)), np.sqrt(dup / (lines + 2.0)), np.sqrt(repeat / (n + 20.0)))
    return out | dict(zip(X, vector, strict=True))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row of statistics per document, in one pass over the texts."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, " + ", ".join(f"{x} double" for x in X)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("quality")
        for batch in batches:
            for i, j, w in common.batches_of(batch, text):
                made = text_stats(w)
                columns = [batch.column(c).slice(i, j - i).cast(t) for c, t in ((key, pa.int64()), (lang, pa.string()), (source, pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, made.values())], names=["doc_id", "lang", "source", *made])
        common.trim()

    return docs.select(key, text, lang, source).mapInArrow(run, schema)


def _vectors(texts: pa.Array) -> pa.Array:
    common.sole("quality")
    names = ["base_failed", *X]
    data, offsets = common.text_buffers(texts)
    made = [text_stats(common.Words(data, offsets[i : j + 1])) for i, j in common.slices(offsets)]
    parts = [np.concatenate([m[c] for m in made]) if made else np.zeros(0, bool if c == "base_failed" else float) for c in names]
    return pa.StructArray.from_arrays([pa.array(p) for p in parts], names=names)


def vector_of(text: Column) -> Column:
    """The base verdict and the vector of each text, beside rows that stay where they are."""
    kinds = ", ".join(f"{x}: double" for x in X)
    return F.arrow_udf(_vectors, f"struct<base_failed: boolean, {kinds}>")(text)


def _same_group(left: DataFrame, right: DataFrame) -> Column:
    return left["lang"].eqNullSafe(right["g_lang"]) & left["source"].eqNullSafe(right["g_source"])


def _with(stats: DataFrame, params: DataFrame) -> DataFrame:
    """Squared distance of every row to its group's estimate."""
    joined = stats.join(params, _same_group(stats, params), "left").drop("g_lang", "g_source")
    rows = [sum((F.col(f"w{i}{j}") * (F.col(X[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(DIMS)]
    # rounded, since sums over a group depend on the order of its rows in their last digits
    return joined.withColumn("d2", F.round(sum((r * r for r in rows), F.lit(0.0)), 6))


def consistency(share: np.ndarray) -> np.ndarray:
    """What the scatter of the nearest share of normal vectors is multiplied by to be that of all."""
    low, high = np.zeros(len(share)), np.full(len(share), 200.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid / 2) * (1 + mid / 2) < share
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    six = 1 - np.exp(-high / 2) * (1 + high / 2 + high * high / 8)
    return np.where(share >= 1, 1.0, share / np.maximum(six, 1e-12))


def _estimates(moments: DataFrame, floor: tuple[float, ...]) -> DataFrame:
    """Centre, and inverse Cholesky factor of the scatter, of each group's moments; scaled by the share that was really taken."""
    pairs = [(i, j) for i in range(DIMS) for j in range(i + 1)]
    schema = "g_lang string, g_source string, n long, " + ", ".join([*(f"m{i} double" for i in range(DIMS)), *(f"w{i}{j} double" for i, j in pairs)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {k: b.column(k).to_numpy(zero_copy_only=False) for k in b.schema.names if k not in GROUP}
            k = np.maximum(col["k"], 1).astype(float)
            scale = consistency(k / np.maximum(col["n"], 1))
            mean = np.stack([col[f"s{i}"] / k for i in range(DIMS)], 1)
            cov = np.zeros((len(k), DIMS, DIMS))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = scale * (col[f"s{i}{j}"] / k - mean[:, i] * mean[:, j])
            cov += np.diag(np.square(floor))
            inverse = np.linalg.inv(np.linalg.cholesky(cov)) if len(k) else cov
            arrays = [b.column("lang"), b.column("source"), pa.array(col["n"], pa.int64())]
            arrays += [pa.array(mean[:, i]) for i in range(DIMS)] + [pa.array(inverse[:, i, j]) for i, j in pairs]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return moments.mapInArrow(run, schema)


def _start(stats: DataFrame, floor: tuple[float, ...], hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Medians and scaled median deviations: a diagonal estimate."""
    mid = stats.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(X[i], 0.5, 1000).alias(f"m{i}") for i in range(DIMS)))
    mid = mid.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    mid = hint(mid)
    off = stats.join(mid, _same_group(stats, mid)).groupBy("g_lang", "g_source").agg(
        F.first("n").alias("n"),
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(DIMS)),
        *(F.percentile_approx(F.abs(F.col(X[i]) - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i in range(DIMS)),
    )
    weight = lambda i: 1 / F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), 2) + floor[i] ** 2)
    w = [(weight(i) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    return off.select("g_lang", "g_source", "n", *(f"m{i}" for i in range(DIMS)), *w)


def _concentrate(stats: DataFrame, params: DataFrame, keep: float, floor: tuple[float, ...]) -> DataFrame:
    """One concentration step. Bins of distance are 1/16 of a power of two wide."""
    near = _with(stats, params)
    cell = F.floor(16 * F.log2(F.col("d2") + 2.0**-12)).alias("cell")
    products = {f"s{i}{j}": F.col(X[i]) * F.col(X[j]) for i in range(DIMS) for j in range(i + 1)} | {f"s{i}": F.col(X[i]) for i in range(DIMS)}
    cells = near.groupBy(*GROUP, cell).agg(F.count(F.lit(1)).alias("k"), *(F.sum(v).alias(c) for c, v in products.items()))
    by_group = Window.partitionBy(*GROUP)
    before = F.coalesce(F.sum("k").over(by_group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nearest = cells.withColumns({"n": F.sum("k").over(by_group), "before": before}).filter(F.col("before") < keep * F.col("n"))
    moments = nearest.groupBy(*GROUP).agg(F.max("n").alias("n"), F.sum("k").alias("k"), *(F.sum(c).alias(c) for c in products))
    return _estimates(moments, floor)


def estimate(stats: DataFrame, keep: float, steps: int, floor: tuple[float, ...] = FLOOR, hint: Callable[[DataFrame], DataFrame] = lambda params: params) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group: so many concentration steps from one start."""
    params = _start(stats, floor, hint)
    for _ in range(steps):
        params = _concentrate(stats, hint(params), keep, floor)
    return params


def pooled(stats: DataFrame, keep: float, steps: int, least: int) -> DataFrame:
    """The estimate that each group is judged by: its own, or that of its language, or of all rows, the first of ``least`` rows."""
    own = common.durable(estimate(stats, keep, steps))
    few = own.filter(F.col("n") < least).select("g_lang", "g_source")
    if not few.limit(1).count():
        return own
    none = F.lit(None).cast("string")
    values = own.columns[2:]
    by_lang = estimate(stats.withColumn("source", none), keep, steps).filter(F.col("n") >= least).select(F.col("g_lang").alias("p_lang"), *values)
    found = common.durable(few.join(by_lang, few["g_lang"].eqNullSafe(by_lang["p_lang"]), "left").select("g_lang", "g_source", *values))
    out = own.filter(F.col("n") >= least).union(found.filter("n is not null"))
    rest = found.filter("n is null").select("g_lang", "g_source")
    if rest.limit(1).count():
        # one row for the whole table
        every = estimate(stats.withColumns({"lang": none, "source": none}), keep, steps, (WIDE, *FLOOR[1:]), F.broadcast).select(*values)
        out = out.union(rest.crossJoin(F.broadcast(every)))
    return common.durable(out)


def _verdict(stats: DataFrame, params: DataFrame, alpha: float, least: int) -> DataFrame:
    outlier = (F.col("n") >= least) & (F.col("d2") > chi2_quantile(1 - alpha, DIMS))
    return _with(stats, params).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outlier, F.lit(False)))


def judge(docs: DataFrame, keep: float = 0.75, alpha: float = 1e-6, steps: int = 3, least: int = 40, **columns: str) -> DataFrame:
    """Statistics, ``base_failed``, squared distance ``d2`` and verdict ``kept`` of every row."""
    stats = common.durable(statistics(docs, **columns))
    return _verdict(stats, pooled(stats, keep, steps, least), alpha, least).select("doc_id", *STATS, "base_failed", "kept", "d2", *X, *GROUP)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents")).select("doc_id", *STATS, "base_failed", "kept")


#: Groups whose estimates are broadcast; with more, the join with them shuffles.
GROUPS = 20_000


def keep_good(docs: DataFrame, keep: float = 0.75, alpha: float = 1e-6, steps: int = 3, least: int = 40) -> DataFrame:
    """The rows of ``docs``, whole, that are not rejected. The texts are read twice in place of being shuffled."""
    stats = common.durable(statistics(docs))
    params = pooled(stats, keep, steps, least)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *GROUP, vector_of(F.col("text")).alias("v")).select("row", *GROUP, "v.*")
    return _verdict(rows, common.small(params, GROUPS), alpha, least).filter("kept").select("row.*")
