"""Streams: moving rates of events, and records that arrive while a crawl runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.buckets import uid_shard
from fathom.schema import RECORD


def sliding_stream(events: DataFrame, window: str = "10 seconds", slide: str = "1 second", late: str = "1 minute", ts: str = "ts") -> DataFrame:
    """How many events each window had; windows close when the watermark has passed them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window, slide)).agg(F.count("*").alias("in_window")).select(F.col("window.end").alias("window_end"), "in_window")


def record_stream(spark: SparkSession, folder: str, schema: T.StructType = RECORD, files: int = 64) -> DataFrame:
    """Records as their Parquet files arrive, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def owner_totals(records: DataFrame) -> DataFrame:
    """Running files and apparent bytes of each owner (which link gets an inode's bytes is settled in batch)."""
    return records.groupBy("uid").agg(F.count_if(F.col("type") == "f").alias("files"), F.sum(F.when(F.col("type") == "f", F.col("size")).otherwise(F.lit(0))).alias("bytes"))


def ingest(records: DataFrame, folder: str, checkpoint: str, shards: int):
    """Appends arriving records to the layout by owner shard, exactly once; ends when all there is is written."""
    placed = records.withColumn("uid_shard", uid_shard(F.col("uid"), shards))
    return placed.writeStream.partitionBy("uid_shard").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
