"""Scans and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.registry import query, table
from tarnflow.session import metadata_session
from tarnflow.sources.generator import generated
from tarnflow.sources.reader import read, read_files, read_table, rows_until, table_size


@query("scan_full", "SELECT * FROM orders")
def scan_full(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("*")


@query("scan_multi_file", "SELECT * FROM customer UNION ALL SELECT * FROM customer")
def scan_multi_file(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/customer.parquet"
    return read_files(spark, [path, path])


@query("scan_recursive", "SELECT count(*) AS n FROM lineitem")
def scan_recursive(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").parquet(f"{sf}/lineitem.parquet")
    return files.agg(F.count("*").alias("n"))


@query("count_star", "SELECT count(*) AS n FROM lineitem")
def count_star(spark: SparkSession, sf: str) -> DataFrame:
    return table(metadata_session(spark), sf, "lineitem").agg(F.count("*").alias("n"))


@query(
    "min_max_count_stats",
    "SELECT min(l_orderkey) AS min_key, max(l_orderkey) AS max_key, min(l_linenumber) AS min_line, max(l_linenumber) AS max_line, count(l_tax) AS n_tax, count(*) AS n FROM lineitem",
)
def min_max_count_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _statistics(table(metadata_session(spark), sf, "lineitem"))


def _statistics(t: DataFrame) -> DataFrame:
    return t.agg(
        F.min("l_orderkey").alias("min_key"),
        F.max("l_orderkey").alias("max_key"),
        F.min("l_linenumber").alias("min_line"),
        F.max("l_linenumber").alias("max_line"),
        F.count("l_tax").alias("n_tax"),
        F.count("*").alias("n"),
    )


@query("count_star_scanned", "SELECT count(*) AS n FROM lineitem")
def count_star_scanned(spark: SparkSession, sf: str) -> DataFrame:
    """The same count without the footers' answer, for comparison: a column is read."""
    return table(spark, sf, "lineitem").agg(F.count("l_orderkey").alias("n"))


@query(
    "min_max_count_scanned",
    "SELECT min(l_orderkey) AS min_key, max(l_orderkey) AS max_key, min(l_linenumber) AS min_line, max(l_linenumber) AS max_line, count(l_tax) AS n_tax, count(*) AS n FROM lineitem",
)
def min_max_count_scanned(spark: SparkSession, sf: str) -> DataFrame:
    return _statistics(table(spark, sf, "lineitem"))


@query("table_stats", "SELECT 'lineitem' AS table_name, count(*) AS n_rows, true AS has_bytes FROM lineitem UNION ALL SELECT 'no such table', -1, false")
def table_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Rows from the footers and whether there are bytes; -1 rows where nothing can be read."""
    found = [(name, *table_size(spark, f"{sf}/{name}.parquet")) for name in ("lineitem", "no such table")]
    return spark.createDataFrame([(name, rows, size > 0) for name, rows, size in found], "table_name string, n_rows long, has_bytes boolean")


@query("source_generated", """SELECT id, CAST(id % 2 = 0 AS BOOLEAN) AS bool_col, CAST(id % 10 AS TINYINT) AS tinyint_col, CAST(id % 100 AS SMALLINT) AS smallint_col, CAST(id % 1000 AS INTEGER) AS int_col, id * 10 AS bigint_col,
       CAST(id / 2.0 AS FLOAT) AS float_col, CAST(id / 4.0 AS DOUBLE) AS double_col, 'str_' || lpad(CAST(id AS VARCHAR), 6, '0') AS string_col, DATE '2000-01-01' + CAST(id AS INTEGER) AS date_col FROM range(1000) t(id)""")
def source_generated(spark: SparkSession, sf: str) -> DataFrame:
    return generated(spark, 1000)


@query("source_table_or_query", "SELECT c_nationkey, count(*) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 0) t GROUP BY c_nationkey")
def source_table_or_query(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, "SELECT * FROM customer WHERE c_acctbal > 0", sf).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("source_options", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")
def source_options(spark: SparkSession, sf: str) -> DataFrame:
    """A SELECT as the table, and a partitioned read of it, by options."""
    options = {"table": "SELECT o_custkey, o_orderdate FROM orders WHERE o_totalprice > 1000", "partition.byColumn": "o_orderdate", "partition.lowerBound": "19960101", "partition.upperBound": "20000101", "partition.size": "4"}
    return read(spark, sf, options).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("fetch_streaming_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def fetch_streaming_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey")
    taken = rows_until(rows, lambda batch: True, batch=100)  # stops after the first batch
    return spark.createDataFrame(taken, rows.schema)


@query("project_cols", "SELECT l_orderkey, l_quantity FROM lineitem")
def project_cols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")


@query("project_alias", "SELECT l_orderkey AS k, l_linenumber AS line, l_extendedprice AS price FROM lineitem")
def project_alias(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"))


@query("project_pruned", "SELECT c_name, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def project_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_acctbal") > 5000).select("c_name", "c_mktsegment")


@query("project_exprs", "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS next_line, upper(l_returnflag) AS flag, l_quantity * 2 AS twice FROM lineitem")
def project_exprs(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") + 1).alias("next_line"), F.upper("l_returnflag").alias("flag"), (F.col("l_quantity") * 2).alias("twice"))


@query("project_quoted", 'SELECT o_orderkey AS "order key", o_orderstatus AS "select" FROM orders')
def project_quoted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey AS `order key`", "o_orderstatus AS `select`")
