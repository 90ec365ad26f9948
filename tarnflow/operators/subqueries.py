"""Subqueries and views, through the SELECT front end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnflow.plans.frontend import run_sql
from tarnflow.registry import query


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a SELECT in the PostgreSQL flavour; DuckDB runs the same text unless given another."""

    def build(spark: SparkSession, sf: str) -> DataFrame:
        return run_sql(spark, text, sf)

    query(name, oracle or text)(build)


sql_query("subquery_from", "SELECT k, count(*) AS n FROM (SELECT o_custkey % 10 AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F') t WHERE p > 1000 GROUP BY k")
sql_query("subq_from_nested", "SELECT max(n) AS most FROM (SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders) a GROUP BY k) b")
sql_query("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql_query("subq_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql_query("subq_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
sql_query("subq_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
sql_query("subq_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql_query("subq_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql_query("cte_chain", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE s > 300000) SELECT count(*) AS n FROM b")
