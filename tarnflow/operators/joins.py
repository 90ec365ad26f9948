"""Joins. Which side is broadcast is left to the optimizer's size check and adaptive execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.coerce import eq_coerced
from tarnflow.registry import query, table


@query("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


_PICKED = "(SELECT * FROM orders WHERE o_totalprice > 100000)"


def _outer(kind: str) -> None:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        c = table(spark, sf, "customer").where("c_acctbal > 0")
        o = table(spark, sf, "orders").where(F.col("o_totalprice") > 100000)
        return c.join(o, c.c_custkey == o.o_custkey, kind).select("c_custkey", "o_orderkey", "o_totalprice")

    query(f"join_{kind}", f"SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM customer WHERE c_acctbal > 0) c {kind.upper()} JOIN {_PICKED} o ON c_custkey = o_custkey")(build)


for _kind in ("left", "right", "full"):
    _outer(_kind)


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select("r_name").crossJoin(table(spark, sf, "nation").select("n_name"))


@query("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query(
    "join_multi",
    """SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
)
def join_multi(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


#: Ranges that an inequality join cuts its values into, and rows of a range that are dealt together.
_RANGES, _DEALT = 32, 1 << 10


def join_less(left: DataFrame, a: Column, right: DataFrame, b: Column) -> DataFrame:
    """Pairs of rows with ``a < b``; the columns of both sides, whose names differ.

    The values of ``b`` are cut at quantiles. A right row is in the range of its ``b`` and, by a hash, in
    one of some parts of it; a left row goes to the parts of its own range and of all above, where all
    match. So it is compared with rows that don't match in one range only, a left row without a match goes
    nowhere, and the parts are spread over all cores, however many files there are and however large the
    sides. The parts also bound what one left row gives at a time, which Spark's joins hold in memory.
    """
    at = [i / _RANGES for i in range(1, _RANGES)]
    rows, most, cuts = right.agg(F.count(b), F.max(b), F.percentile_approx(b, at, 1000)).first()
    cuts = sorted(set(cuts or []))
    parts = max(1, rows // ((len(cuts) + 1) * _DEALT))

    def range_of(value: Column) -> Column:
        return sum([(value >= F.lit(c)).cast("int") for c in cuts], F.lit(0))

    tasks = 8 * right.sparkSession.sparkContext.defaultParallelism
    first, last = range_of(F.col("_a")) * parts, F.lit((len(cuts) + 1) * parts - 1)
    spread = left.withColumn("_a", a).where(F.col("_a") < F.lit(most)).withColumn("_part", F.explode(F.sequence(first, last)))
    part = range_of(F.col("_b")) * parts + F.pmod(F.xxhash64(*right.columns), F.lit(parts))
    dealt = right.withColumn("_b", b).where("_b IS NOT NULL").withColumn("_part", part.cast("int"))
    joined = spread.repartition(tasks, "_part").join(dealt.repartition(tasks, "_part").hint("merge"), "_part")
    return joined.where(F.col("_a") < F.col("_b")).select(*left.columns, *right.columns)


@query("join_theta", "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_acctbal < p_retailprice - 900")
def join_theta(spark: SparkSession, sf: str) -> DataFrame:
    s, p = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return join_less(s, F.col("s_acctbal"), p, F.col("p_retailprice") - 900).select("s_suppkey", "p_partkey")


@query(
    "join_range",
    """SELECT e.event_id, o.o_orderkey FROM events e JOIN orders o ON o.o_custkey = e.user_id
       AND o.o_totalprice BETWEEN e.value * 100 AND e.value * 100 + 2000""",
)
def join_range(spark: SparkSession, sf: str) -> DataFrame:
    e, o = table(spark, sf, "events"), table(spark, sf, "orders")
    return e.join(o, (o.o_custkey == e.user_id) & o.o_totalprice.between(e.value * 100, e.value * 100 + 2000)).select("event_id", "o_orderkey")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 50000)")
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where(F.col("o_totalprice") > 50000)
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 50000)")
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where(F.col("o_totalprice") > 50000)
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def _typed(name: str, left: str, right: str, oracle_left: str, oracle_right: str) -> None:
    """Registers a count of an equi-join of two types over small key ranges."""

    def build(spark: SparkSession, sf: str) -> DataFrame:
        a = table(spark, sf, "supplier").select(F.expr(left).alias("a"))
        b = table(spark, sf, "nation").select(F.expr(right).alias("b"))
        return a.join(b, eq_coerced(a, "a", b, "b")).agg(F.count("*").alias("n"))

    query(name, f"SELECT count(*) AS n FROM (SELECT {oracle_left} AS a FROM supplier) x JOIN (SELECT {oracle_right} AS b FROM nation) y ON x.a = y.b")(build)


_typed("join_int_tinyint", "s_nationkey", "cast(n_nationkey AS tinyint)", "s_nationkey", "CAST(n_nationkey AS TINYINT)")
_typed("join_int_smallint", "s_nationkey", "cast(n_nationkey AS smallint)", "s_nationkey", "CAST(n_nationkey AS SMALLINT)")
_typed("join_int_bigint", "s_nationkey", "cast(n_nationkey AS bigint)", "s_nationkey", "CAST(n_nationkey AS BIGINT)")
_typed("join_int_float", "s_nationkey", "cast(n_nationkey AS float)", "s_nationkey", "CAST(n_nationkey AS FLOAT)")
_typed("join_int_double", "s_nationkey", "cast(n_nationkey AS double)", "s_nationkey", "CAST(n_nationkey AS DOUBLE)")
_typed("join_float_double", "cast(s_nationkey AS float)", "cast(n_nationkey AS double)", "CAST(s_nationkey AS FLOAT)", "CAST(n_nationkey AS DOUBLE)")
_typed("join_bool_tinyint", "s_nationkey % 2 = 0", "cast(n_nationkey AS tinyint)", "CAST(s_nationkey % 2 = 0 AS TINYINT)", "CAST(n_nationkey AS TINYINT)")
_typed("join_string_string", "cast(s_nationkey AS string)", "cast(n_nationkey AS string)", "CAST(s_nationkey AS VARCHAR)", "CAST(n_nationkey AS VARCHAR)")


@query("join_skewed", "SELECT l_returnflag, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def join_skewed(spark: SparkSession, sf: str) -> DataFrame:
    """Adaptive execution splits hot keys of the sort-merge join; the distinct count is partial first."""
    l, o = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = l.join(o.hint("merge"), l.l_orderkey == o.o_orderkey)
    return joined.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))
