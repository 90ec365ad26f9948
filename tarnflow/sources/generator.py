"""Rows made up by a rule, for trying things out: the same for the same numbers, in any number of partitions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generated(spark: SparkSession, rows: int, first: int = 0, partitions: int | None = None) -> DataFrame:
    """``rows`` rows from number ``first`` on, with a column of each plain type."""
    i = F.col("id")
    return spark.range(first, first + rows, 1, partitions).select(
        "id",
        (i % 2 == 0).alias("bool_col"),
        (i % 10).cast("tinyint").alias("tinyint_col"),
        (i % 100).cast("smallint").alias("smallint_col"),
        (i % 1000).cast("int").alias("int_col"),
        (i * 10).alias("bigint_col"),
        (i / 2).cast("float").alias("float_col"),
        (i / 4).alias("double_col"),
        F.format_string("str_%06d", i).alias("string_col"),
        F.date_add(F.lit(dt.date(2000, 1, 1)), i.cast("int")).alias("date_col"),
    )


def write_sharded(rows: DataFrame, path: str, shards: int, key: str) -> None:
    """Rows as Parquet in ``shards`` folders by a hash of their key, for tables of many files."""
    number = F.pmod(F.xxhash64(key), F.lit(shards))
    rows.repartitionById(shards, number.cast("int")).withColumn("shard", number).write.partitionBy("shard").parquet(path)
