"""Spark sessions with the settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results or plans; everything else is left to the cluster.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # a side of up to 64 MB, by the optimizer's estimate or a stage's real size, is sent instead of dealt
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
}


def build_session(master: str | None = None, app: str = "tarnflow", **conf: str) -> SparkSession:
    """A session with ENGINE_CONF; ``master`` defaults to what spark-submit or the environment says.

    Extra settings are given with dots written as double underscores, e.g.
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app).config(map=ENGINE_CONF)
    if master or os.environ.get("TARNFLOW_MASTER"):
        builder = builder.master(master or os.environ["TARNFLOW_MASTER"])
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def metadata_session(spark: SparkSession) -> SparkSession:
    """A sibling session whose Parquet scans answer COUNT, MIN and MAX from file footers.

    The V2 Parquet source is switched on in the sibling only, so other scans keep the V1 path.
    """
    sibling = spark.newSession()
    sibling.conf.set("spark.sql.sources.useV1SourceList", "")
    sibling.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    sibling.conf.set("spark.sql.session.timeZone", "UTC")
    return sibling
