"""Predicates. Each reaches the Parquet scan where Parquet can use it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.registry import query, table

_ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _orders(name: str, where: str, predicate) -> None:
    """Registers a filter over orders."""

    def build(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "orders").where(predicate()).select(*_ORDER)

    query(name, f"SELECT {', '.join(_ORDER)} FROM orders WHERE {where}")(build)


def _col(name: str) -> Column:
    return F.col(name)


def _maybe() -> Column:
    """A column with nulls: the customer of orders that are not open."""
    return F.when(_col("o_orderstatus") != "O", _col("o_custkey"))


_MAYBE = "CASE WHEN o_orderstatus <> 'O' THEN o_custkey END"

_orders("filter_eq", "o_orderstatus = 'F'", lambda: _col("o_orderstatus") == "F")
_orders("filter_ne", "o_orderstatus <> 'F'", lambda: _col("o_orderstatus") != "F")
_orders("filter_range", "o_totalprice >= 10000 AND o_totalprice < 20000 AND o_custkey > 5 AND o_custkey <= 1000", lambda: (_col("o_totalprice") >= 10000) & (_col("o_totalprice") < 20000) & (_col("o_custkey") > 5) & (_col("o_custkey") <= 1000))
_orders("filter_null_safe_eq", f"({_MAYBE}) IS NOT DISTINCT FROM (CASE WHEN o_custkey % 2 = 0 THEN o_custkey END)", lambda: _maybe().eqNullSafe(F.when(_col("o_custkey") % 2 == 0, _col("o_custkey"))))
_orders("filter_and_or", "(o_orderstatus = 'F' AND o_totalprice > 50000) OR o_custkey < 10", lambda: ((_col("o_orderstatus") == "F") & (_col("o_totalprice") > 50000)) | (_col("o_custkey") < 10))
_orders("filter_not", "NOT (o_orderstatus = 'F' OR o_totalprice > 50000)", lambda: ~((_col("o_orderstatus") == "F") | (_col("o_totalprice") > 50000)))
_orders("filter_is_null", f"({_MAYBE}) IS NULL", lambda: _maybe().isNull())
_orders("filter_is_not_null", f"({_MAYBE}) IS NOT NULL AND o_orderkey IS NOT NULL", lambda: _maybe().isNotNull() & _col("o_orderkey").isNotNull())
_orders("filter_in", "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)", lambda: _col("o_orderpriority").isin("1-URGENT", "2-HIGH") & _col("o_custkey").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89))
_orders("filter_in_empty", "1 = 0", lambda: _col("o_custkey").isin([]))
_orders("filter_not_in", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", lambda: ~_col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
_orders("filter_starts", "starts_with(o_orderpriority, '1')", lambda: _col("o_orderpriority").startswith("1"))
_orders("filter_ends", "ends_with(o_orderpriority, 'H')", lambda: _col("o_orderpriority").endswith("H"))
_orders("filter_contains", "contains(o_orderpriority, 'E')", lambda: _col("o_orderpriority").contains("E"))
_orders("filter_always_true", "1 = 1", lambda: F.lit(True))
_orders("filter_always_false", "1 = 0", lambda: F.lit(False))
_orders("filter_col_col", "o_custkey < o_orderkey", lambda: _col("o_custkey") < _col("o_orderkey"))
_orders("filter_date", "o_orderdate < DATE '1996-01-01'", lambda: _col("o_orderdate") < F.lit(dt.date(1996, 1, 1)).cast("timestamp_ntz"))
_orders("filter_ts", "o_orderdate >= TIMESTAMP '1996-06-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-07-01 00:00:00'", lambda: (_col("o_orderdate") >= F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")) & (_col("o_orderdate") < F.lit("1996-07-01 00:00:00").cast("timestamp_ntz")))
_orders("filter_like", "o_orderpriority LIKE '%-H_GH'", lambda: _col("o_orderpriority").like("%-H_GH"))
_orders("filter_like_escaped", "o_orderpriority || '%' LIKE '4-%!%' ESCAPE '!'", lambda: F.like(F.concat("o_orderpriority", F.lit("%")), F.lit("4-%!%"), F.lit("!")))
_orders("filter_between", "o_totalprice BETWEEN 1000 AND 30000", lambda: _col("o_totalprice").between(1000, 30000))
_orders("filter_case", "CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 40000 ELSE o_totalprice < 10000 END", lambda: F.when(_col("o_orderstatus") == "F", _col("o_totalprice") > 40000).otherwise(_col("o_totalprice") < 10000))
_orders("filter_function", "length(o_orderpriority) > 6 AND year(o_orderdate) = 1997", lambda: (F.length("o_orderpriority") > 6) & (F.year("o_orderdate") == 1997))
_orders("filter_multi", "o_orderstatus = 'F' AND o_totalprice > 1000 AND o_custkey % 7 = 3 AND o_orderpriority <> '5-LOW'", lambda: (_col("o_orderstatus") == "F") & (_col("o_totalprice") > 1000) & (_col("o_custkey") % 7 == 3) & (_col("o_orderpriority") != "5-LOW"))
