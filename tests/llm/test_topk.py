import math
import random

import numpy as np
import pytest

from tarnflow.llm import topk_search
from tarnflow.llm.topk_search import Shard, top_k


def brute(rows, k, is_query):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(n, seed, width=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.5, -0.25, 0.1, rng.uniform(-1, 1)]) for _ in range(width)]) for i in range(n)]
    rows += [(n + i, [0.5] * width) for i in range(40)]
    rows += [(n + 50, None), (n + 51, [1.0, None]), (n + 52, [float("nan")] * width), (n + 53, [float("inf")] * width), (n + 54, []), (n + 55, [0.3, -0.7]), (None, [0.1] * width), (n + 56, [1e6] * width), (n + 57, [-1e6] * width)]
    return rows


@pytest.mark.parametrize(("k", "block"), [(5, 256), (5, 4), (1, 3), (200, 16)])
def test_equals_brute_force(spark, k, block):
    rows = vectors(120, k)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string").repartition(3)
    got = top_k(df, df["vec_id"] % 7 == 0, k, block_rows=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, lambda q: q % 7 == 0)


@pytest.mark.parametrize(("least", "queries", "most_bytes"), [(20, 8, 1 << 26), (20, 8, 0), (7, 3, 1 << 26)])
def test_many_shards_and_query_blocks(spark, monkeypatch, least, queries, most_bytes):
    monkeypatch.setattr(topk_search, "LEAST_SHARD", least)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", queries)
    monkeypatch.setattr(topk_search, "BOUND_BYTES", most_bytes)
    rows = vectors(150, least)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, top_k(df, df["vec_id"] % 3 == 0, 4).collect())) == brute(rows, 4, lambda q: q % 3 == 0)


def test_a_shard_of_empty_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "LEAST_SHARD", 1)
    df = spark.createDataFrame([(k, []) for k in range(5)] + [(7, [1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in top_k(df, df["vec_id"] == 0, 3).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 0), (3, 0)]
    got = [(r.vec_id, r.score) for r in top_k(df, df["vec_id"] == 7, 2).orderBy("rank").collect()]
    assert got == [(0, 0), (1, 0)]


def test_the_least_component_keeps_its_sign(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1e30]), (2, [0.5])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in top_k(df, df["vec_id"] == 0).orderBy("rank").collect()]
    assert got == [(2, 256 * 128), (1, -(2**63) + 2)]


def test_bounds_of_enormous_components_do_not_wrap():
    q, most, least = np.array([[2**62, 2**62]]), np.array([[4, 4]]), np.array([[-1, -1]])
    assert topk_search.bounds(q, most, least)[0, 0] == 2**63 - 1


def test_no_rows_and_no_queries(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty, empty["vec_id"] % 2 == 0).count() == 0
    df = spark.createDataFrame([(1, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert top_k(df, df["vec_id"] % 2 == 0).count() == 0
    assert top_k(df, df["vec_id"] == 1).collect()[0].score == 256 * 512


def test_bounds_hold():
    rng = np.random.default_rng(5)
    rows, queries = rng.integers(-50, 50, (300, 8)), rng.integers(-50, 50, (20, 8))
    shard = Shard(np.arange(300), rows, 32)
    limits = topk_search.bounds(queries, shard.most, shard.least)
    for b, block in enumerate(shard.rows):
        assert ((queries @ block.T).max(1) <= limits[:, b]).all()


def test_enormous_components_stay_in_64_bits(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in top_k(df, df["vec_id"] == 0).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, -(2**63) + 2)]
