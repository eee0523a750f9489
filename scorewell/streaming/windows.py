"""Windowed statistics over an unbounded prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scorewell.operators.monitor import windowed_summary

WATERMARK = "1 hour"


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """New parquet files of a folder as a stream; the trigger size bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_windows(log: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Statistics per event-time window; rows later than the watermark are dropped with their windows."""
    return windowed_summary(log.withWatermark("ts", watermark), width, slide)


def write_closed_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each window once the watermark has passed its end."""
    return (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_all_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep all windows so far, closed or not: each micro-batch adds the windows it changed, under its number.

    A batch that runs again replaces its own folder. Windows the watermark has passed leave the state.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        windows.writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_windows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest state of each window that ``write_all_windows`` has kept (``schema``: that of the windows)."""
    kept = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    newest = kept.groupBy("window_start").agg(F.max_by(F.struct(*schema.names), "batch").alias("w"))
    return newest.select("w.*")
