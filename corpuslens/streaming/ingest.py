"""Incremental passes as structured streams: new files once, windows over events.

The batch passes resume by anti-joins; these do the same continuously.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_table(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_pass(rows: DataFrame, key: str, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Appends the transform of every new row to a table, each batch in a folder of its own
    that a repeated batch overwrites: exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and kind; works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events with gaps of at most ``gap``."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
