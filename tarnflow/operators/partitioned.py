"""Partitioned reads: each must return every row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.registry import query, table
from tarnflow.sources.partitioned import read_partitioned

_ORACLE = "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, round(sum(o_totalprice), 2) AS total FROM orders"


def _read(name: str, options: dict[str, str]) -> None:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        rows = read_partitioned(table(spark, sf, "orders"), options)
        return rows.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    query(name, _ORACLE)(build)


_read("partitioned_read_hash", {"partition.byColumn": "o_custkey", "partition.size": "6"})
_read("partitioned_read_long", {"partition.byColumn": "o_orderkey", "partition.lowerBound": "100", "partition.upperBound": "9000", "partition.size": "5"})
_read("partitioned_read_double", {"partition.byColumn": "o_totalprice", "partition.lowerBound": "1000.5", "partition.upperBound": "90000.25"})
_read("partitioned_read_date", {"partition.byColumn": "o_orderdate", "partition.lowerBound": "1995-06-01", "partition.upperBound": "2000-12-31 12:00:00", "partition.size": "4"})
_read("partitioned_read_date_digits", {"partition.byColumn": "o_orderdate", "partition.lowerBound": "19960301", "partition.upperBound": "20000401", "partition.size": "5"})
_read("partitioned_read_predicates", {"partition.predicates": "o_orderstatus = 'F'; o_orderstatus = 'O' | o_orderstatus NOT IN ('F', 'O')"})


@query("partitioned_read_filtered", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 80000")
def partitioned_read_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_partitioned(table(spark, sf, "orders"), {"partition.byColumn": "o_orderkey", "partition.lowerBound": "0", "partition.upperBound": "10000"})
    return rows.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 80000)).select("o_orderkey")


@query("partitioned_read_nulls", "SELECT count(*) AS n FROM orders")
def partitioned_read_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Null keys and keys outside the bounds are read as well."""
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("k"))
    return read_partitioned(rows, {"partition.byColumn": "k", "partition.lowerBound": "10", "partition.upperBound": "20"}).agg(F.count("*").alias("n"))
