"""Writes, as round trips through a new folder of the session's shared place."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.registry import query, table
from tarnflow.sources.writer import VersionedTable, complex_as_json, insert_into, mapped_types, write_table
from tarnflow.streaming.sink import write_stream


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed at the end; a local one only on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="tarnflow-")
        atexit.register(shutil.rmtree, base, True)
    path = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have gone, and the folder with it
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


@query("write_append", f"{_ORDERS} UNION ALL {_ORDERS} WHERE o_orderstatus = 'F'")
def write_append(spark: SparkSession, sf: str) -> DataFrame:
    target = VersionedTable(spark, scratch(spark))
    target.append(_orders(spark, sf))
    target.append(_orders(spark, sf).where("o_orderstatus = 'F'"))
    return target.read()


@query("write_overwrite", f"{_ORDERS} WHERE o_totalprice > 50000")
def write_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    target = VersionedTable(spark, scratch(spark))
    target.write(_orders(spark, sf))
    target.write(target.read().where("o_totalprice > 50000"), mode="overwrite")
    return target.read()


@query(
    "merge_upsert",
    f"""{_ORDERS} WHERE o_orderstatus <> 'F'
        UNION ALL SELECT o_orderkey, o_custkey, 'done', o_totalprice FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT -o_orderkey - 1, NULL, 'new', o_totalprice FROM orders WHERE o_totalprice > 100000""",
)
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed change of one column of some rows, then new rows with some of the columns."""
    o = _orders(spark, sf)
    target = VersionedTable(spark, scratch(spark))
    target.write(o)
    target.write(o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("done").alias("o_orderstatus")), keys=["o_orderkey"])
    added = o.where("o_totalprice > 100000").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("new").alias("o_orderstatus"), "o_totalprice")
    target.write(added, keys=["o_orderkey"])
    return target.read()


@query("write_prepared", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'it''s ?; -- new' UNION ALL SELECT 101, NULL")
def write_prepared(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    write_table(spark, path, table(spark, sf, "region"))
    insert_into(spark, path, ["r_regionkey", "r_name"], [(100, "it's ?; -- new"), (101, None)])
    return VersionedTable(spark, path).read()


@query("write_options", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM orders")
def write_options(spark: SparkSession, sf: str) -> DataFrame:
    """Type mapping and batch size of one write."""
    path = scratch(spark)
    kind = dict(_orders(spark, sf).dtypes)["o_orderkey"]
    write_table(spark, path, _orders(spark, sf).select("o_orderkey", "o_totalprice"), {"write.typeMapping": f"{kind}:string", "batch.size": "5000"})
    return VersionedTable(spark, path).read()


@query("write_type_mapping", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def write_type_mapping(spark: SparkSession, sf: str) -> DataFrame:
    target = VersionedTable(spark, scratch(spark))
    target.write(mapped_types(table(spark, sf, "nation"), "int:bigint;float:double"))
    return target.read()


@query("write_complex_json", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS place, '[' || n_nationkey || ',' || n_regionkey || ']' AS keys FROM nation")
def write_complex_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("place"), F.array("n_nationkey", "n_regionkey").alias("keys"))
    target = VersionedTable(spark, scratch(spark))
    target.write(complex_as_json(rows))
    return target.read()


@query("stream_sink", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'view'")
def stream_sink(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch(spark)
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    picked = stream.where("event_type <> 'view'").select("event_id", "user_id", "event_type", "value")
    write_stream(picked, f"{base}/out", f"{base}/checkpoint").awaitTermination()  # to its end, or its error
    return spark.read.parquet(f"{base}/out").drop("batch")
