"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.registry import query, table


def _by(*order):
    return Window.partitionBy("o_custkey").orderBy(*order)


_KEY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _dated():
    return _by("o_orderdate", "o_orderkey")


@query(
    "win_rank",
    f"""SELECT o_orderkey, CAST(row_number() OVER ({_KEY}) AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS rk,
        CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS dr, CAST(ntile(3) OVER ({_KEY}) AS INTEGER) AS nt,
        round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS pr FROM orders""",
)
def win_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = _by("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(_dated()).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.ntile(3).over(_dated()).alias("nt"), F.round(F.percent_rank().over(p), 6).alias("pr"))


@query(
    "win_lag_lead",
    f"""SELECT o_orderkey, lag(o_totalprice) OVER ({_KEY}) AS before, lead(o_totalprice, 2) OVER ({_KEY}) AS after2,
        first_value(o_orderkey) OVER ({_KEY}) AS first_key,
        last_value(o_orderkey) OVER ({_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key FROM orders""",
)
def win_lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    whole = _dated().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_totalprice").over(_dated()).alias("before"), F.lead("o_totalprice", 2).over(_dated()).alias("after2"), F.first("o_orderkey").over(_dated()).alias("first_key"), F.last("o_orderkey").over(whole).alias("last_key"))


@query("win_running_sum", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER ({_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(25,2)) AS running FROM orders")
def win_running_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = _dated().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(15,2)")).over(w).cast("decimal(25,2)").alias("running"))


@query("win_moving_avg", f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({_KEY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def win_moving_avg(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(_dated().rowsBetween(-2, 0)), 4).alias("moving"))


@query("win_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS near FROM events")
def win_range_frame(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("user_id").rangeBetween(-5, 0)
    return table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("near"))


@query("win_ratio", "SELECT n_nationkey, c, round(c / sum(c) OVER (PARTITION BY n_regionkey), 6) AS share FROM (SELECT n_nationkey, n_regionkey, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey)")
def win_ratio(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    counts = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_nationkey", "n_regionkey").agg(F.count("*").alias("c"))
    return counts.select("n_nationkey", "c", F.round(F.col("c") / F.sum("c").over(Window.partitionBy("n_regionkey")), 6).alias("share"))


@query("win_top_per_group", f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def win_top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    w = _by(F.desc("o_totalprice"), F.asc("o_orderkey"))
    return table(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey", "o_totalprice")
