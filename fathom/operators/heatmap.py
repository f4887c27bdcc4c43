"""The age x size heat map and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.buckets import age_bucket, badge_visible, basis_time, change_led, size_bucket
from fathom.functions.formats import BLUE, ROSE, cell_colour, led_label
from fathom.operators.credit import with_credit

MEASURES = ["files", "bytes", "led_files", "led_bytes"]


def bucketed(records: DataFrame, now: int, basis: str = "effective") -> DataFrame:
    """Files with their buckets, credited bytes and whether they are change-led."""
    files = with_credit(records.where("type = 'f'"))
    return files.withColumns({"age_bucket": age_bucket(basis_time(basis), now), "size_bucket": size_bucket(F.col("size")), "led": change_led()})


def cells(records: DataFrame, now: int, basis: str = "effective") -> DataFrame:
    """age_bucket, size_bucket, files, bytes, led_files, led_bytes of the cells that have files."""
    return bucketed(records, now, basis).groupBy("age_bucket", "size_bucket").agg(
        F.count("*").alias("files"), F.sum("credited").alias("bytes"),
        F.count_if("led").alias("led_files"), F.sum(F.when(F.col("led"), F.col("credited")).otherwise(F.lit(0))).cast("long").alias("led_bytes"),
    )


def dense(grid: DataFrame) -> DataFrame:
    """All 36 cells; empty ones are 0."""
    spark = grid.sparkSession
    frame = spark.range(6).select(F.col("id").cast("int").alias("age_bucket")).crossJoin(spark.range(6).select(F.col("id").cast("int").alias("size_bucket")))
    return frame.join(grid, ["age_bucket", "size_bucket"], "left").na.fill(0, MEASURES)


def margins(grid: DataFrame) -> DataFrame:
    """Cells, row, column and grand totals; -1 stands for all buckets. Over at most 36 rows."""
    cube = grid.cube("age_bucket", "size_bucket").agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])
    return cube.select(*[F.coalesce(c, F.lit(-1)).cast("int").alias(c) for c in ("age_bucket", "size_bucket")], *MEASURES)


def shares(grid: DataFrame) -> DataFrame:
    """Each cell's percentages of all files and bytes, of the largest cell, and its colours."""
    total = grid.agg(F.sum("files").alias("all_files"), F.sum("bytes").alias("all_bytes"), F.max("files").alias("most_files"), F.max("bytes").alias("most_bytes"))
    part = lambda a, b: F.when(F.col(b) > 0, F.lit(100.0) * F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    # one row
    out = grid.crossJoin(F.broadcast(total)).withColumns({"files_percent": part("files", "all_files"), "bytes_percent": part("bytes", "all_bytes"), "files_heat": part("files", "most_files"), "bytes_heat": part("bytes", "most_bytes")})
    return out.withColumns({"files_colour": cell_colour(F.col("files_heat"), *ROSE), "bytes_colour": cell_colour(F.col("bytes_heat"), *BLUE)}).drop("all_files", "all_bytes", "most_files", "most_bytes")


def badges(grid: DataFrame) -> DataFrame:
    """Labels of the change-led share of each cell's bytes, and whether it is shown."""
    return grid.select("age_bucket", "size_bucket", "bytes", "led_bytes", led_label(F.col("led_bytes"), F.col("bytes")).alias("label"), badge_visible(F.col("led_bytes"), F.col("bytes")).alias("visible"))
