"""Aggregation. Spark runs each as a partial aggregate before the shuffle and a final one after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.registry import query, table


def _lineitem(name: str, select: str, *aggregates, where: str | None = None, by: str | None = None) -> None:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        t = table(spark, sf, "lineitem")
        if where:
            t = t.where(where)
        return t.groupBy(*(by.split(", ") if by else [])).agg(*[a() for a in aggregates])

    keys = f"{by}, " if by else ""
    query(name, f"SELECT {keys}{select} FROM lineitem{f' WHERE {where}' if where else ''}{f' GROUP BY {by}' if by else ''}")(build)


_MAYBE = "CASE WHEN l_linenumber > 3 THEN l_tax END"

_lineitem("count_col", f"count({_MAYBE}) AS n, count(*) AS n_all", lambda: F.count(F.expr(_MAYBE)).alias("n"), lambda: F.count("*").alias("n_all"))
_lineitem("count_one", "count(1) AS n", lambda: F.count(F.lit(1)).alias("n"))
_lineitem("count_distinct", "count(DISTINCT l_suppkey) AS n_supp, count(DISTINCT l_returnflag) AS n_flag", lambda: F.countDistinct("l_suppkey").alias("n_supp"), lambda: F.countDistinct("l_returnflag").alias("n_flag"))
_lineitem("sum_col", "round(sum(l_quantity), 2) AS q, CAST(sum(l_linenumber) AS BIGINT) AS lines", lambda: F.round(F.sum("l_quantity"), 2).alias("q"), lambda: F.sum("l_linenumber").alias("lines"))
_lineitem("sum_expr", "round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue", lambda: F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 4).alias("revenue"))
_lineitem("sum_null_only", "sum(CASE WHEN l_linenumber < 0 THEN l_tax END) AS s", lambda: F.sum(F.expr("CASE WHEN l_linenumber < 0 THEN l_tax END")).alias("s"))
_lineitem("sum_distinct", "CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s", lambda: F.sum_distinct("l_linenumber").alias("s"))
_lineitem("min_max", "min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, min(l_returnflag) AS a, max(l_returnflag) AS z", lambda: F.min("l_shipdate").alias("first_day"), lambda: F.max("l_shipdate").alias("last_day"), lambda: F.min("l_returnflag").alias("a"), lambda: F.max("l_returnflag").alias("z"))
_lineitem("avg_col", "round(avg(l_quantity), 6) AS q, round(avg(l_discount), 6) AS d", lambda: F.round(F.avg("l_quantity"), 6).alias("q"), lambda: F.round(F.avg("l_discount"), 6).alias("d"))
_lineitem("group_by_one", "count(*) AS n", lambda: F.count("*").alias("n"), by="l_returnflag")
_lineitem("group_by_multi", "count(*) AS n, round(sum(l_quantity), 2) AS q", lambda: F.count("*").alias("n"), lambda: F.round(F.sum("l_quantity"), 2).alias("q"), by="l_returnflag, l_linestatus")
_lineitem("agg_filtered", "count(*) AS n, round(sum(l_quantity), 2) AS q", lambda: F.count("*").alias("n"), lambda: F.round(F.sum("l_quantity"), 2).alias("q"), where="l_quantity > 25", by="l_linestatus")
_lineitem("sum_decimal_cast", "CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS s", lambda: F.sum(F.expr("cast(l_extendedprice AS decimal(15,2))")).cast("decimal(25,2)").alias("s"), by="l_returnflag")
_lineitem("stddev_pop_samp", "round(stddev_samp(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS p, round(var_samp(l_quantity), 4) AS v", lambda: F.round(F.stddev_samp("l_quantity"), 6).alias("s"), lambda: F.round(F.stddev_pop("l_quantity"), 6).alias("p"), lambda: F.round(F.var_samp("l_quantity"), 4).alias("v"), by="l_returnflag")


@query("percentile_exact", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY l_returnflag")
def percentile_exact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5)).alias("median"))


@query("group_by_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def group_by_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("collect_sorted", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def collect_sorted(spark: SparkSession, sf: str) -> DataFrame:
    names = F.concat_ws(",", F.array_sort(F.collect_list("n_name")))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(names.alias("names"))


@query(
    "partial_final_merge",
    """SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_linenumber > 3 THEN l_tax END) AS n_tax, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
       CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS q FROM lineitem GROUP BY l_returnflag""",
)
def partial_final_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Partials by part of the table, merged by the rule of each function: counts and sums add up."""
    part = F.pmod(F.col("l_orderkey"), F.lit(8)).alias("part")
    partial = (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag", part)
        .agg(
            F.count("*").alias("n"),
            F.count(F.expr("CASE WHEN l_linenumber > 3 THEN l_tax END")).alias("n_tax"),
            F.min("l_extendedprice").alias("lo"),
            F.max("l_extendedprice").alias("hi"),
            F.sum(F.expr("cast(l_quantity AS decimal(15,2))")).alias("q"),
        )
    )
    return partial.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("n_tax").alias("n_tax"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("q").cast("decimal(25,2)").alias("q"))


@query("group_counts_sum_to_total", "SELECT count(*) AS total, count(*) AS total_of_groups FROM lineitem")
def group_counts_sum_to_total(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    groups = t.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("total"), F.sum("n").alias("total_of_groups"))


@query(
    "q1_decimal_exprs",
    """SELECT l_returnflag, l_linestatus, CAST(sum(p * (1 - d)) AS DECIMAL(38,4)) AS disc_price, CAST(sum(p * (1 - d) * (1 + t)) AS DECIMAL(38,6)) AS charge
       FROM (SELECT l_returnflag, l_linestatus, CAST(l_extendedprice AS DECIMAL(15,2)) AS p, CAST(l_discount AS DECIMAL(15,2)) AS d, CAST(l_tax AS DECIMAL(15,2)) AS t FROM lineitem)
       GROUP BY l_returnflag, l_linestatus""",
)
def q1_decimal_exprs(spark: SparkSession, sf: str) -> DataFrame:
    money = [F.col(c).cast("decimal(15,2)").alias(a) for c, a in (("l_extendedprice", "p"), ("l_discount", "d"), ("l_tax", "t"))]
    t = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", *money)
    price = F.expr("p * (1 - d)")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum(price).cast("decimal(38,4)").alias("disc_price"), F.sum(price * (1 + F.col("t"))).cast("decimal(38,6)").alias("charge"))


@query(
    "decimal_arith",
    """SELECT o_orderkey, CAST(a + b AS DECIMAL(16,2)) AS s, CAST(a - b AS DECIMAL(16,2)) AS d, CAST(a * b AS DECIMAL(31,4)) AS m
       FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS a, CAST(o_custkey AS DECIMAL(15,2)) AS b FROM orders)""",
)
def decimal_arith(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("a"), F.col("o_custkey").cast("decimal(15,2)").alias("b"))
    return t.select("o_orderkey", (F.col("a") + F.col("b")).alias("s"), (F.col("a") - F.col("b")).alias("d"), (F.col("a") * F.col("b")).alias("m"))


@query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where(F.col("n") > 12)


def _grouping(name: str, clause: str, group) -> None:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return group(table(spark, sf, "orders")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    query(name, f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {clause}")(build)


_COLS = ("o_orderstatus", "o_orderpriority")
_grouping("rollup", "ROLLUP (o_orderstatus, o_orderpriority)", lambda t: t.rollup(*_COLS))
_grouping("cube", "CUBE (o_orderstatus, o_orderpriority)", lambda t: t.cube(*_COLS))
_grouping("grouping_sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", lambda t: t.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], *_COLS))


@query("approx_distinct_users", "SELECT count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem")
def approx_distinct_users(spark: SparkSession, sf: str) -> DataFrame:
    """The sketch's estimate is within five of its standard errors of the exact count."""
    t = table(spark, sf, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("e"))
    return t.select(F.col("e").alias("exact"), (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("close"))
