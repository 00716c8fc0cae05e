"""A publication log as a stream: late repeats dropped, event-time counts, and the current pointer kept up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, folder: str, schema: StructType, max_files: int = 8) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def distinct_publications(log: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Each event once; state older than the watermark is dropped, so it stays bounded."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(log: DataFrame, *, window: str = "1 day") -> DataFrame:
    """Events and value per type and window of event time."""
    grouped = log.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def keep_pointers(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the last event of each key in every batch under the batch's number; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("generation_id"), F.max("ts").alias("ts"))
        last.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_pointers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("user_id").agg(F.max_by("generation_id", F.struct("ts", "generation_id")).alias("generation_id"))
