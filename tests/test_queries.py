"""Every registered query against its DuckDB text on the smallest tables."""

import math

import duckdb
import pytest

import tarnflow.operators  # noqa: F401
from tarnflow.plans.frontend import TABLES
from tarnflow.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list):
        return str([plain(x) for x in v])
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert name in ORACLES
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert got == want


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
