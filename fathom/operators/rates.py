"""Moving rates of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_rates(events: DataFrame, pane: int = 1, panes: int = 10, ts: str = "ts") -> DataFrame:
    """For each pane of `pane` seconds that has events: how many the last `panes` panes had, and the rate:
    per pane, over as many panes as have passed. Batch form of streaming.rates.sliding_stream()."""
    at = F.floor(F.unix_timestamp(ts) / pane).cast("long")
    counts = events.groupBy(at.alias("pane")).agg(F.count("*").alias("n"))  # bounded by time, not by events
    first = counts.agg(F.min("pane").alias("first"))
    # days overlap by the window's width, so that no task orders all time
    width = max(panes, 86400 // pane)
    day = F.floor(F.col("pane") / width)
    doubled = counts.withColumn("block", F.explode(F.array(day, day + 1)))
    w = Window.partitionBy("block").orderBy("pane").rangeBetween(-(panes - 1), 0)
    summed = doubled.withColumn("in_window", F.sum("n").over(w)).where(F.floor(F.col("pane") / width) == F.col("block"))
    seen = F.least(F.lit(panes), F.col("pane") - F.col("first") + 1)
    return summed.crossJoin(F.broadcast(first)).select("pane", "n", "in_window", (F.col("in_window") / seen).alias("rate"))


def rate_statistics(rates: DataFrame) -> DataFrame:
    return rates.agg(F.avg("rate").alias("mean_rate"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"), F.sum("n").alias("events"))
