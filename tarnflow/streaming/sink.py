"""Streams into versioned tables, and windows over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tarnflow.sources.writer import VersionedTable


def write_stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """All that is available, in micro-batches; a batch that is run again changes nothing twice.

    With keys each batch is merged; of a batch's rows that share a key the greatest by a hash of the row
    counts, so a repeat chooses the same. Without, each batch goes to a folder of its own number, which
    a repeat overwrites.
    """

    def put(batch: DataFrame, number: int) -> None:
        if keys:
            VersionedTable(batch.sparkSession, path).merge(one_of_each(batch, keys), keys)
        else:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, chosen by its content alone."""
    content = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    order = Window.partitionBy(*keys).orderBy(content)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def event_time(column: str = "ts") -> Column:
    """A timestamp that watermarks accept."""
    return F.col(column).cast("timestamp")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values per window and type; works on streams and on tables."""
    rows = events.withColumn("ts", event_time())
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
