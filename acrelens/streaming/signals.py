"""Signals as a stream: new files become events once each, and counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_signals(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that appear in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once_each(signals: DataFrame, key: list[str], time: str = "created_at", late: str = "1 day") -> DataFrame:
    """The first of each key within the time that events may come late; state older than that is forgotten."""
    return signals.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def counts(signals: DataFrame, by: list[str], time: str = "created_at", size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Signals per window and key; a window is final when the watermark passes it."""
    grouped = signals.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), *by, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to the Parquet event log what has come so far, exactly once, then stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
