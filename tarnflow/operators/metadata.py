"""Metadata commands as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.plans.evidence import inspect
from tarnflow.plans.frontend import run_sql
from tarnflow.registry import query, table
from tarnflow.session import metadata_session
from tarnflow.sources.catalog import Catalog, query_schema


def _values(rows: list[tuple], names: str) -> str:
    quoted = [", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) for row in rows]
    return f"SELECT * FROM (VALUES {', '.join(f'({q})' for q in quoted)}) t({names})"


def _info(name: str, oracle: str, build) -> None:
    query(name, oracle)(lambda spark, sf: build(Catalog.of_folder(spark, sf)))


_info("info_catalogs", "SELECT 'spark_catalog' AS catalog_name", lambda c: c.info_catalogs())
_info("info_schemas", "SELECT 'spark_catalog' AS catalog_name, 'main' AS db_schema_name", lambda c: c.info_schemas("M%"))
_info("info_table_types", "SELECT 'TABLE' AS table_type", lambda c: c.info_table_types())
_info(
    "info_tables",
    """SELECT 'spark_catalog' AS catalog_name, 'main' AS db_schema_name, unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages',
       'benchmark', 'labels', 'conversations']) AS table_name, 'TABLE' AS table_type""",
    lambda c: c.info_tables(),
)
_info("info_tables_like", "SELECT 'spark_catalog' AS catalog_name, 'main' AS db_schema_name, 'part' AS table_name, 'TABLE' AS table_type", lambda c: c.info_tables(table_pattern="P_RT"))
_info(
    "info_types",
    """SELECT type_name, data_type, column_size, quote AS literal_prefix, quote AS literal_suffix, create_params, 1 AS nullable, type_name = 'VARCHAR' AS case_sensitive,
       CASE WHEN type_name IN ('ARRAY', 'STRUCT') THEN 0 ELSE 3 END AS searchable, false AS unsigned_attribute, false AS fixed_prec_scale, false AS auto_increment, type_name AS local_type_name,
       0 AS minimum_scale, maximum_scale, CAST(NULL AS INTEGER) AS sql_data_type, CAST(NULL AS INTEGER) AS datetime_subcode, num_prec_radix, CAST(NULL AS INTEGER) AS interval_precision
       FROM (VALUES ('TINYINT', -6, 3, NULL, NULL, 0, 10), ('BIGINT', -5, 19, NULL, NULL, 0, 10), ('BINARY', -2, 2147483647, NULL, 'length', 0, NULL),
       ('DECIMAL', 3, 38, NULL, 'precision, scale', 38, 10), ('INTEGER', 4, 10, NULL, NULL, 0, 10), ('SMALLINT', 5, 5, NULL, NULL, 0, 10), ('REAL', 7, 7, NULL, NULL, 0, 10),
       ('DOUBLE', 8, 15, NULL, NULL, 0, 10), ('VARCHAR', 12, 2147483647, '''', 'length', 0, NULL), ('BOOLEAN', 16, 1, NULL, NULL, 0, 2), ('DATE', 91, 10, '''', NULL, 0, NULL),
       ('TIME', 92, 15, '''', NULL, 6, NULL), ('TIMESTAMP', 93, 26, '''', NULL, 6, NULL), ('STRUCT', 2002, NULL, NULL, NULL, 0, NULL), ('ARRAY', 2003, NULL, NULL, NULL, 0, NULL))
       t(type_name, data_type, column_size, quote, create_params, maximum_scale, num_prec_radix)""",
    lambda c: c.info_types(),
)
_info(
    "info_sql",
    """SELECT * FROM (VALUES ('server_name', 'tarnflow'), ('server_version', '0.0.1'), ('arrow_version', '0.0.1'), ('read_only', 'true'), ('sql', 'true'), ('substrait', 'false'), ('transactions', 'none'),
       ('ddl_catalog', 'false'), ('ddl_schema', 'true'), ('ddl_table', 'true'), ('identifier_case', 'lowercase'), ('quoted_identifier_case', 'unknown'), ('all_tables_selectable', 'true'),
       ('null_ordering', 'sorted at end'), ('max_columns_in_table', '1000')) t(info_name, value)""",
    lambda c: c.info_sql(),
)
_info("info_columns", _values([("r_regionkey", "int", 1), ("r_name", "string", 2)], "column_name, data_type, ordinal"), lambda c: c.info_columns("main", "region"))
_info("info_ddl", """SELECT 'region' AS table_name, 'CREATE TABLE main.region("r_regionkey" INTEGER, "r_name" VARCHAR)' AS ddl""", lambda c: c.info_ddl("main", "region"))


@query("query_schema", _values([("k", "bigint", 1), ("n", "bigint", 2), ("total", "double", 3)], "column_name, data_type, ordinal"))
def schema_of_query(spark: SparkSession, sf: str) -> DataFrame:
    return query_schema(run_sql(spark, "SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey", sf))


@query("persisted_table_q1", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def persisted_table_q1(spark: SparkSession, sf: str) -> DataFrame:
    """A table over the files that stays in the session catalog; its name follows from the place."""
    import hashlib

    name = f"tarnflow_lineitem_{hashlib.sha256(sf.encode()).hexdigest()[:12]}"
    rows = Catalog.of_folder(spark, sf).persist("main", "lineitem", name)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "explain",
    """SELECT * FROM (VALUES ('count', 'footer-count', true, NULL, NULL), ('stats', 'footer-stats', true, NULL, NULL), ('scan', 'scan', true, NULL, NULL), ('group', 'aggregation', true, NULL, NULL),
       ('join', 'join', true, NULL, NULL), ('join and group', 'mixed', true, NULL, NULL), ('filtered count', 'fallback', false, 'aggregation', 'a filter on rows can''t be answered from footers'),
       ('text minimum', 'fallback', false, 'aggregation', 'footers hold no exact minimum or maximum of l_returnflag'), ('no scan', 'unknown', false, NULL, 'the plan scans no files'))
       t(shape, path, pushdown, target, reason)""",
)
def explain(spark: SparkSession, sf: str) -> DataFrame:
    footers = table(metadata_session(spark), sf, "lineitem")
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    joined = l.join(o, l.l_orderkey == o.o_orderkey)
    shapes = {
        "count": footers.agg(F.count("*")),
        "stats": footers.agg(F.min("l_orderkey"), F.count("l_tax")),
        "scan": l.where("l_quantity > 10").select("l_orderkey"),
        "group": l.groupBy("l_returnflag").count(),
        "join": joined.select("l_orderkey"),
        "join and group": joined.groupBy("o_orderstatus").count(),
        "filtered count": footers.where("l_quantity > 10").agg(F.count("*")),
        "text minimum": footers.agg(F.min("l_returnflag")),
        "no scan": spark.range(3).select("id"),
    }
    found = {k: inspect(v, footers_wanted=k in ("count", "stats", "filtered count", "text minimum")) for k, v in shapes.items()}
    return spark.createDataFrame([(k, e.label, e.pushdown, e.target, e.reason) for k, e in found.items()], "shape string, path string, pushdown boolean, target string, reason string")
