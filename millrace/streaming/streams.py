"""Structured Streaming forms of the stateless maps and of dedup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def parquet_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup_stream(stream: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def running_peaks(stream: DataFrame, key: str, value: str) -> DataFrame:
    return stream.groupBy(key).agg(F.max(value).alias(f"peak_{value}"))


def map_batches(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Applies a batch function to each micro-batch and appends the result as Parquet under the batch's number, so a repeated batch overwrites its own."""

    def each(df: DataFrame, number: int) -> None:
        fn(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs what is there to a Parquet folder and returns."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
