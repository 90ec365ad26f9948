"""Sorting, limits and top-k. Nulls sort last, and ties are broken by a unique key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.registry import query, table


@query("order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def order_by(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), F.asc_nulls_last("c_custkey"))


@query("order_by_nulls", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS maybe FROM orders ORDER BY maybe NULLS LAST, o_orderkey")
def order_by_nulls(spark: SparkSession, sf: str) -> DataFrame:
    maybe = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("maybe")
    return table(spark, sf, "orders").select("o_orderkey", maybe).orderBy(F.asc_nulls_last("maybe"), "o_orderkey")


@query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 30")
def limit_offset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(30).limit(20)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
