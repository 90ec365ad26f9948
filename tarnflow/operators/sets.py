"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnflow.registry import query, table


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf, "customer").selectExpr("c_nationkey AS k")
    suppliers = table(spark, sf, "supplier").where("s_acctbal > 5000").selectExpr("s_nationkey AS k")
    return customers, suppliers


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"


def _set(name: str, word: str, combine) -> None:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return combine(*_both(spark, sf))

    query(name, f"{_A} {word} {_B}")(build)


_set("union_all", "UNION ALL", lambda a, b: a.unionByName(b))
_set("union_distinct", "UNION", lambda a, b: a.unionByName(b).distinct())
_set("intersect", "INTERSECT", lambda a, b: a.intersect(b))
_set("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b))
_set("except", "EXCEPT", lambda a, b: a.subtract(b))
_set("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b))
