"""The join on an inequality against all pairs, and its plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import joins
from tarnflow.operators.joins import join_less
from tarnflow.registry import QUERIES

NAN, INF = math.nan, math.inf


def less(a, b):
    """Spark's and DuckDB's order: NaN is above all numbers; null is in no pair."""
    return a is not None and b is not None and not math.isnan(a) and (math.isnan(b) or a < b)


def pairs(spark, lefts, rights):
    x = spark.createDataFrame(list(enumerate(lefts)), "i long, a double")
    y = spark.createDataFrame(list(enumerate(rights)), "j long, b double")
    return join_less(x, F.col("a"), y, F.col("b")).select("i", "j")


@pytest.mark.parametrize("dealt", [1 << 10, 2])
def test_inequality_join_equals_all_pairs(spark, monkeypatch, dealt):
    monkeypatch.setattr(joins, "_DEALT", dealt)
    rng = random.Random(3)
    odd = [None, NAN, INF, -INF, 0.0, -0.0, 1e300, -1e300]
    spread = [rng.uniform(-10, 10) for _ in range(150)]
    ties = [float(rng.randint(0, 3)) for _ in range(150)]
    for lefts, rights in ((odd + spread, odd + ties), (odd + ties, spread), (ties, [2.0] * 300), (ties, odd), (spread, []), ([], spread), (ties, [None]), ([None], ties)):
        got = sorted(map(tuple, pairs(spark, lefts, rights).collect()))
        assert got == [(i, j) for i, a in enumerate(lefts) for j, b in enumerate(rights) if less(a, b)]


def test_theta_join_compares_no_side_with_all_of_the_other(spark, sf):
    plan = QUERIES["join_theta"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
