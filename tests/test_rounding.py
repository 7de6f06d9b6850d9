"""Rounding and sums that decide an order: as the SQL does it, and the same in any order."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import render, seeds

#: Values at a rounding edge, with the digits kept: weights and similarities met over 0.1 and 1 GB, and a plain tie.
EDGES = [(1.0655318525, 9), (1.3157826854999999, 9), (0.1315789475, 9), (0.5454545454999999, 9), (0.285, 2), (-0.285, 2), (0.125, 2), (-2.5, 0)]


def test_rounded_goes_by_the_double(spark):
    duckdb = pytest.importorskip("duckdb")
    row = tuple(spark.range(1).select(*(T.rounded(F.lit(v), d).alias(f"c{i}") for i, (v, d) in enumerate(EDGES))).first())
    assert row == duckdb.connect().execute("select " + ", ".join(f"round({v!r}::double, {d})" for v, d in EDGES)).fetchone()
    assert row[:2] == (1.065531852, 1.315782686)
    assert spark.range(1).select(T.rounded(F.lit(None).cast("double"), 2)).first()[0] is None


def test_settled_is_the_sql_s_in_spark_and_in_tasks(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(1)
    values = [*(k * 1000 + 499 for k in rng.integers(0, 2 * 10**6, 3000).tolist()), *(-k * 1000 - 501 for k in rng.integers(0, 10**6, 300).tolist())]
    values = [k / 1e9 for k in values]  # all at an edge, once the hair is added
    want = [x for (x,) in duckdb.connect().execute("select round(unnest(?::double[]) + 1e-9::double, 6)", [values]).fetchall()]
    got = [x for (x,) in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(T.settled(F.col("v"))).collect()]
    assert got == want
    assert [T.settled_number(v) for v in values] == want


def test_weights_are_rounded_as_the_sql_does(spark):
    row = spark.createDataFrame([(1.0655318525, 0.0, 0.0, 0.0)], "seed_score double, bridge double, ground double, coverage double")
    assert seeds.objective_weights(row).first()["weight"] == 1.065531852  # times 1e9 it lies below the half


def test_greedy_values_are_exact_and_rounded_half_up():
    dist = np.asarray([[0, 0, 5], [0, 0, 5], [5, 4, 0]], float)
    assert seeds.choose_seeds(np.asarray([1.0, 1.0, 5e-8]), dist, 1, 5) == [1]  # 2.5 against 2 units of the seventh digit
    rng = np.random.default_rng(0)
    weight, near = np.round(rng.random(20), 9), rng.integers(0, 5, (20, 20)).astype(float)
    order = rng.permutation(20)
    again = seeds.choose_seeds(weight[order], near[np.ix_(order, order)], 4, 4)
    assert [int(order[i]) for i in again] == seeds.choose_seeds(weight, near, 4, 4)


def test_values_of_mmr_are_settled_as_the_sql_s(spark):
    fields = "qid long, pos long, node string, text string, base double, best_score double, is_main boolean, is_support boolean, is_connector boolean, overlap long, locality double"
    rows = spark.createDataFrame([(1, 0, "s::1:0", "one", 3.499e-06, 0.0, False, False, False, 0, 0.0)], fields)
    assert render.mmr(rows).first()["value"] == 4e-06  # 3.5e-06 once the hair is added
