"""Exact quantiles and tails: one buffer and narrowing passes alike, against plain Python."""

from __future__ import annotations

import math
import random

import pytest

from threadloom.operators import quantiles as Q
from threadloom.operators import metrics

KINDS = {
    "even": lambda r, i: r.random(),
    "wide": lambda r, i: 10.0 ** r.randint(-300, 300) * r.choice((-1, 1)),
    "tied": lambda r, i: float(r.choice((1, 1, 1, 1, 2, 7))),
    "one": lambda r, i: 5.0,
    "near": lambda r, i: math.nextafter(1.0, 2.0) if i % 2 else 1.0,
    None: lambda r, i: float(i % 37),
}


def rows(n=700):
    r = random.Random(5)
    made = [(kind, f(r, i)) for kind, f in KINDS.items() for i in range(n)]
    return made + [("few", 3.0), ("few", None), ("few", 4.0), ("empty", None)]


def interpolated(values, p):
    at = p * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low] if low == high else (high - at) * values[low] + (at - low) * values[high]


@pytest.mark.parametrize("most", [100_000, 0])
def test_quantiles_and_tails(spark, most):
    made = rows()
    df = spark.createDataFrame(made, "kind string, ms double").repartition(3)
    groups = {}
    for kind, v in made:
        if v is not None:
            groups.setdefault(kind, []).append(v)
    close = lambda a, b: math.isclose(a, b, rel_tol=1e-12)
    found = {r["g"]["kind"]: r for r in Q.quantiles(df, ["kind"], {"ms": {"least": 0.0, "median": 0.5, "p90": 0.9, "most": 1.0}}, most).collect()}
    assert found.keys() == groups.keys()
    for kind, values in groups.items():
        values.sort()
        for name, p in (("least", 0.0), ("median", 0.5), ("p90", 0.9), ("most", 1.0)):
            assert close(found[kind][name], interpolated(values, p)), (kind, name)
    ends = {r["kind"]: r for r in Q.tails(df, "ms", ["kind"], 0.3, most).collect()}
    assert ends.keys() == groups.keys()
    for kind, values in groups.items():
        k = max(1, math.floor(len(values) * 0.3))
        assert math.isclose(ends[kind]["low"], math.fsum(values[:k]) / k, rel_tol=1e-9) and math.isclose(ends[kind]["high"], math.fsum(values[-k:]) / k, rel_tol=1e-9), kind


def test_describe_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 4.0), ("none", None)], "kind string, ms double")
    got = {r["kind"]: (r["n"], r["mean"], r["median"], r["p90"], r["max"]) for r in metrics.describe(df, "ms", ["kind"]).collect()}
    assert got == {"a": (2, 1.5, 1.5, 1.9, 2.0), None: (1, 4.0, 4.0, 4.0, 4.0), "none": (0, None, None, None, None)}
    assert metrics.describe(df.limit(0), "ms", ["kind"]).count() == 0 and Q.quantiles(df.limit(0), ["kind"], {"ms": {"m": 0.5}}, -1).count() == 0
    assert metrics.fast_slow(df.limit(0), "ms", ["kind"]).count() == 0


def test_one_buffer_is_bounded(spark):
    """Beyond the bound no plan holds an exact percentile's buffer."""
    df = spark.range(500).selectExpr("id % 2 as kind", "cast(id as double) as ms")
    plan = Q.quantiles(df, ["kind"], {"ms": {"m": 0.5}}, 10)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
