"""Reading: files, a table or a SELECT by one name, and rows in batches with an early stop."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from tarnflow.plans.frontend import run_sql
from tarnflow.session import metadata_session
from tarnflow.sources.partitioned import read_partitioned

_SELECT = re.compile(r"\s*\(?\s*(select|with)\b", re.IGNORECASE)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All rows of some files of one schema; a path given twice is read twice."""
    once = list(dict.fromkeys(paths))
    rows = spark.read.parquet(*once)
    for path in once:
        for _ in range(paths.count(path) - 1):
            rows = rows.unionByName(spark.read.parquet(path))
    return rows


def read_table(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """``table`` is a table of the folder, or the text of a SELECT over its tables."""
    if _SELECT.match(table):
        return run_sql(spark, table, folder)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def read(spark: SparkSession, folder: str, options: dict[str, str]) -> DataFrame:
    """A read by options: ``table`` (a name, or a SELECT) and partition.* as ``read_partitioned`` takes them."""
    if not options.get("table"):
        raise ValueError("a read needs the option table")
    return read_partitioned(read_table(spark, options["table"], folder), options)


def table_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rows, from the footers alone, and bytes of a table; -1 for what can't be read."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = int(where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength())
    except Exception:  # whatever store it is
        size = -1
    try:
        rows = metadata_session(spark).read.parquet(path).count() if size >= 0 else -1
    except (PySparkException, Py4JJavaError):
        rows = -1
    return rows, size


def rows_until(df: DataFrame, stop: Callable[[list[Row]], bool], batch: int = 1024) -> list[Row]:
    """Rows in batches until ``stop`` says so of a batch; later partitions are then never run."""
    taken: list[Row] = []
    held: list[Row] = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == batch:
            taken += held
            if stop(held):
                return taken
            held = []
    return taken + held
