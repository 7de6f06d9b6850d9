"""Exact order statistics of groups of any size, without a group in one buffer or one sorted window."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diffusion import cut
from .sizes import small

#: Distinct values of a group that one aggregation buffer may hold; groups of more are narrowed pass by pass.
MOST = 100_000
#: Where a pass cuts an interval: at these shares of its distinct values.
GRID = [i / 64 for i in range(1, 64)]


def held(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct values with their frequencies: g (the keys as a struct, so null keys meet), c (the column), v, w. Nulls take no part."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns)))
    melted = rows.select(F.struct(F.lit(0).alias("all"), *by).alias("g"), each.alias("e")).select("g", "e.c", "e.v").filter("v is not null")
    return melted.groupBy("g", "c", "v").agg(F.count(F.lit(1)).alias("w"))


def at_ranks(values: DataFrame, targets: DataFrame, settle: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """The values at given ranks: g, c, k, value.

    values: g, c, v, w; targets: g, c, k, rank (from 0, below the group's
    number of rows). Each pass holds one interval of values for a rank, cuts it
    at quantiles that a mergeable sketch estimates, counts the cells and goes on
    with the cell that has the rank. The sketch only places the cuts; the counts
    are exact, and the interval's least value is always a cell of its own, so
    every pass narrows. A row lies in one interval or in none.
    """
    ends = values.groupBy("g", "c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    found: DataFrame | None = None
    live = settle(targets.join(ends, ["g", "c"]))
    while True:
        new = live.filter("lo = hi").select("g", "c", "k", F.col("lo").alias("value"))
        found = new if found is None else found.union(new)
        live = live.filter("lo < hi")
        if live.limit(1).count() == 0:
            return found
        spans = small(settle(live.select("g", "c", "lo", "hi").distinct()))
        inside = lambda table: values.join(table, ["g", "c"]).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        cuts = inside(spans).groupBy("g", "c", "lo", "hi").agg(F.percentile_approx("v", GRID, 10_000).alias("cuts"))
        cuts = settle(cuts.withColumn("cuts", F.array_distinct(F.concat(F.array("lo"), "cuts"))))
        cell = F.size(F.filter("cuts", lambda x: x < F.col("v")))
        cells = inside(small(cuts)).groupBy("g", "c", "lo", "hi", cell.alias("cell")).agg(F.sum("w").alias("n"), F.min("v").alias("from"), F.max("v").alias("to"))
        upto = F.sum("n").over(Window.partitionBy("g", "c", "lo", "hi").orderBy("cell"))  # as many rows as there are cuts
        cells = cells.withColumn("upto", upto)
        hit = live.join(cells, ["g", "c", "lo", "hi"]).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        live = settle(hit.select("g", "c", "k", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("from").alias("lo"), F.col("to").alias("hi")))


def in_one_buffer(values: DataFrame, most: int = MOST) -> bool:
    """Whether no group has more than so many distinct values."""
    widest = values.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (widest or 0) <= most


def quantiles(rows: DataFrame, by: Sequence[str], points: Mapping[str, Mapping[str, float]], most: int = MOST) -> DataFrame:
    """Exact quantiles by linear interpolation: g, and a column for each name.

    points: column -> {name: share}. Groups of few distinct values are taken
    from their frequencies in one buffer, larger ones by ``at_ranks``; both
    give the same values. A group whose values are all null has no row or nulls.
    """
    values = held(rows, by, list(points))
    if in_one_buffer(values, most):
        # a column's name is the case of its values, so all columns share the pass
        each = [F.percentile(F.when(F.col("c") == c, F.col("v")), F.lit(p), F.col("w")).alias(name) for c, named in points.items() for name, p in named.items()]
        return values.groupBy("g").agg(*each)
    values = cut(values)
    shares = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for c, named in points.items() for name, p in named.items())))
    totals = values.groupBy("g", "c").agg(F.sum("w").alias("n"))
    place = totals.join(totals.select("g").distinct().select("g", shares.alias("s")).select("g", "s.*"), ["g", "c"]).withColumn("at", F.col("p") * (F.col("n") - 1))
    place = cut(place.select("g", "c", "name", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct())
    met = at_ranks(values, place.select("g", "c", F.struct("name", "rank").alias("k"), "rank")).select("g", "c", "k.name", "k.rank", "value").join(place, ["g", "c", "name", "rank"])
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    between = F.when(F.count(F.lit(1)) == 1, low).otherwise((F.max("rank") - F.first("at")) * low + (F.first("at") - F.min("rank")) * high)
    single = met.groupBy("g", "name").agg(between.alias("value"))
    names = [name for named in points.values() for name in named]
    return single.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in names))


def beside(summary: DataFrame, by: Sequence[str], found: DataFrame, columns: Sequence[Column | str]) -> DataFrame:
    """A summary by the same keys with the columns of ``quantiles`` beside it; null keys meet."""
    keyed = summary.withColumn("g", F.struct(F.lit(0).alias("all"), *by))
    return keyed.join(found, "g", "left").select(*columns)


def tails(rows: DataFrame, value: str, by: Sequence[str], share: float, most: int = MOST) -> DataFrame:
    """Means of the lowest and the highest share of each group's values, one row each at least: the keys, low, high.

    Rows equal to the last value of a tail are worth the same, so a tail is what
    lies beyond that value and as many of its rows as are left.
    """
    values = held(rows, by, [value])
    one_buffer = in_one_buffer(values, most)
    values = values if one_buffer else cut(values)
    totals = values.groupBy("g", "c").agg(F.sum("w").alias("n")).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * share)))
    if one_buffer:
        up = F.sum("w").over(Window.partitionBy("g").orderBy("v"))
        counted = values.withColumn("upto", up).join(small(totals), ["g", "c"])
        low = F.greatest(F.lit(0), F.least(F.col("w"), F.col("k") - F.col("upto") + F.col("w")))
        high = F.greatest(F.lit(0), F.least(F.col("w"), F.col("upto") - F.col("n") + F.col("k")))
    else:
        ranks = F.explode(F.array(F.struct(F.lit("low").alias("k"), (F.col("k") - 1).alias("rank")), F.struct(F.lit("high").alias("k"), (F.col("n") - F.col("k")).alias("rank"))))
        met = at_ranks(values, totals.select("g", "c", ranks.alias("r")).select("g", "c", "r.*")).groupBy("g", "c").pivot("k", ["low", "high"]).agg(F.first("value"))
        met = cut(met.join(totals, ["g", "c"]).withColumnsRenamed({"low": "t_low", "high": "t_high"}))
        # rows of the last value stand for what is left of the tail
        beyond = values.join(small(met), ["g", "c"]).groupBy("g", "c").agg(
            *(F.first(c).alias(c) for c in ("k", "t_low", "t_high")), F.sum(F.when(F.col("v") < F.col("t_low"), F.col("w")).otherwise(0)).alias("n_low"), F.sum(F.when(F.col("v") > F.col("t_high"), F.col("w")).otherwise(0)).alias("n_high"),
            F.sum(F.when(F.col("v") < F.col("t_low"), F.col("w") * F.col("v")).otherwise(0.0)).alias("s_low"), F.sum(F.when(F.col("v") > F.col("t_high"), F.col("w") * F.col("v")).otherwise(0.0)).alias("s_high"),
        )
        mean = lambda end: ((F.col(f"s_{end}") + (F.col("k") - F.col(f"n_{end}")) * F.col(f"t_{end}")) / F.col("k")).alias(end)
        return beyond.select(*(F.col(f"g.{b}").alias(b) for b in by), mean("low"), mean("high"))
    return counted.groupBy("g").agg((F.sum(low * F.col("v")) / F.max("k")).alias("low"), (F.sum(high * F.col("v")) / F.max("k")).alias("high")).select(*(F.col(f"g.{b}").alias(b) for b in by), "low", "high")
