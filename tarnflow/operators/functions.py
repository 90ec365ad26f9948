"""Scalar functions by family."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.coerce import ratio
from tarnflow.registry import query, table


@query(
    "fn_string",
    """SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_mktsegment) AS l, trim('  ' || c_name || ' ') AS t, substring(c_name, 1, 4) AS s, concat(c_name, '/', c_mktsegment) AS c,
       concat_ws('-', c_name, c_mktsegment) AS w, CAST(length(c_name) AS INTEGER) AS n, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS lp, rpad(CAST(c_custkey AS VARCHAR), 8, '.') AS rp,
       replace(c_name, 'Customer', 'C') AS r, string_split(c_name, '#')[1] AS sp, regexp_extract(c_name, '([0-9]+)', 1) AS rx, regexp_replace(c_name, '[0-9]', 'n', 'g') AS rr,
       CAST(instr(c_name, '#') AS INTEGER) AS i FROM customer""",
)
def fn_string(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.upper("c_mktsegment").alias("u"),
        F.lower("c_mktsegment").alias("l"),
        F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("t"),
        F.substring("c_name", 1, 4).alias("s"),
        F.concat("c_name", F.lit("/"), "c_mktsegment").alias("c"),
        F.concat_ws("-", "c_name", "c_mktsegment").alias("w"),
        F.length("c_name").alias("n"),
        F.lpad(key, 8, "0").alias("lp"),
        F.rpad(key, 8, ".").alias("rp"),
        F.replace("c_name", F.lit("Customer"), F.lit("C")).alias("r"),
        F.split("c_name", "#")[0].alias("sp"),
        F.regexp_extract("c_name", "([0-9]+)", 1).alias("rx"),
        F.regexp_replace("c_name", "[0-9]", "n").alias("rr"),
        F.instr("c_name", "#").alias("i"),
    )


@query(
    "fn_date",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS first_day,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS later,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS months, strftime(o_orderdate, '%Y/%m/%d') AS text FROM orders""",
)
def fn_date(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("y"),
        F.month("o_orderdate").alias("m"),
        F.dayofmonth("o_orderdate").alias("d"),
        F.trunc(day, "month").cast("timestamp_ntz").alias("first_day"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"),
        F.date_add(day, 10).alias("later"),
        F.add_months(day, 2).alias("months"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("text"),
    )


@query(
    "fn_math",
    """SELECT o_orderkey, abs(o_totalprice - 50000) AS a, round(o_totalprice / 7, 3) AS r, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c, round(sqrt(o_totalprice), 6) AS s,
       round(pow(o_custkey, 1.5), 4) AS p, o_custkey % 7 AS m, CAST(sign(o_totalprice - 50000) AS DOUBLE) AS g, round(ln(o_totalprice), 8) AS l,
       CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE round(o_totalprice / (o_custkey % 5), 4) END AS q FROM orders""",
)
def fn_math(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.abs(price - 50000).alias("a"),
        F.round(price / 7, 3).alias("r"),
        F.floor(price).alias("f"),
        F.ceil(price).alias("c"),
        F.round(F.sqrt(price), 6).alias("s"),
        F.round(F.pow("o_custkey", F.lit(1.5)), 4).alias("p"),
        (F.col("o_custkey") % 7).alias("m"),
        F.signum(price - 50000).alias("g"),
        F.round(F.ln(price), 8).alias("l"),
        F.round(ratio(price, F.col("o_custkey") % 5), 4).alias("q"),
    )


@query(
    "fn_conditional",
    """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber > 3 THEN l_tax END, -1) AS c, nullif(l_returnflag, 'N') AS n,
       CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'mid' ELSE 'high' END AS w, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS l FROM lineitem""",
)
def fn_conditional(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("l_quantity") < 10, "low").when(F.col("l_quantity") < 40, "mid").otherwise("high")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.coalesce(F.when(F.col("l_linenumber") > 3, F.col("l_tax")), F.lit(-1.0)).alias("c"),
        F.nullif("l_returnflag", F.lit("N")).alias("n"),
        size.alias("w"),
        F.greatest("l_tax", "l_discount").alias("g"),
        F.least("l_tax", "l_discount").alias("l"),
    )


@query(
    "fn_array",
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS head, list_contains(embedding, embedding[2]) AS has,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm2 FROM embeddings""",
)
def fn_array(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    square = F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf, "embeddings").select("vec_id", F.size(v).alias("n"), F.element_at(v, 1).alias("head"), F.array_contains(v, F.element_at(v, 2)).alias("has"), F.round(square, 6).alias("norm2"))


@query("fn_explode", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def fn_explode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))


@query("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events")
def fn_json(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), parsed["k"].alias("n"))


@query("udf_vectorised", "SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS p FROM orders")
def udf_vectorised(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("double")
    def dearer(price: pd.Series) -> pd.Series:
        return price * 1.1

    return table(spark, sf, "orders").select("o_orderkey", F.round(dearer("o_totalprice"), 4).alias("p"))


@query("udaf_weighted", "SELECT o_custkey, round(sum(o_totalprice * o_orderkey) / sum(o_orderkey), 4) AS p FROM orders GROUP BY o_custkey")
def udaf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """A grouped-aggregate function; the groups are a customer's orders, so each is small."""

    @F.pandas_udf("double")
    def weighted(price: pd.Series, weight: pd.Series) -> float:
        return float((price * weight).sum() / weight.sum())

    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(weighted("o_totalprice", "o_orderkey"), 4).alias("p"))


@query("udtf_words", "SELECT r_regionkey, unnest(string_split(r_name, 'A')) AS part FROM region")
def udtf_words(spark: SparkSession, sf: str) -> DataFrame:
    @F.udtf(returnType="part string")
    class Parts:
        def eval(self, text: str):
            for part in text.split("A"):
                yield (part,)

    spark.udtf.register("tarnflow_parts", Parts)
    table(spark, sf, "region").createOrReplaceTempView("region")
    return spark.sql("SELECT r_regionkey, part FROM region, LATERAL tarnflow_parts(r_name)")
