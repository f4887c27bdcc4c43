"""Totals of a report and of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.buckets import change_led
from fathom.operators.credit import with_credit


def long_sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def measures() -> list[Column]:
    of = lambda kinds, x: F.when(F.col("type").isin(*kinds), x).otherwise(F.lit(0))
    file, led = F.col("type") == "f", F.col("led") & (F.col("type") == "f")
    bytes_ = F.when(file, F.col("credited")).otherwise(F.lit(0))
    return [
        F.count("*").alias("matched"), F.count_if(file).alias("files"), F.count_if(F.col("type") == "d").alias("dirs"), F.count_if(F.col("type") == "l").alias("links"),
        F.count_if(~F.col("type").isin("f", "d", "l")).alias("others"), long_sum(bytes_).alias("total_bytes"),
        long_sum(F.when(~F.col("type").isin("f", "d", "l"), F.col("size")).otherwise(F.lit(0))).alias("total_other_bytes"),
        long_sum(F.col("credited")).alias("total_capacity_bytes"), F.count_if(~file).alias("non_files"), long_sum(F.when(~file, F.col("size")).otherwise(F.lit(0))).alias("capacity_in_non_files"),
        F.count_if(led).alias("led_files"), long_sum(F.when(led, F.col("credited")).otherwise(F.lit(0))).alias("led_bytes"), F.count_distinct("uid").alias("distinct_uids"),
    ]


def totals(records: DataFrame, uid: int | None = None) -> DataFrame:
    """One row of a report's totals, for everyone or one owner; bytes are credited among the owner's records."""
    mine = records if uid is None else records.where(F.col("uid") == uid)
    out = with_credit(mine).withColumn("led", change_led()).agg(*measures())
    if uid is None:  # all are scanned and all match: no second scan
        return out.withColumn("scanned", F.col("matched"))
    return out.crossJoin(F.broadcast(records.agg(F.count("*").alias("scanned"))))  # one row


def by_uid(records: DataFrame) -> DataFrame:
    """Files, credited bytes and all records of each owner."""
    return with_credit(records).groupBy("uid").agg(F.count("*").alias("records"), F.count_if(F.col("type") == "f").alias("files"), long_sum(F.when(F.col("type") == "f", F.col("credited"))).alias("bytes"))


def crawl_totals(records: DataFrame) -> DataFrame:
    """One row: what a crawl counts as it goes."""
    kind = lambda k: F.col("type") == k
    other = ~F.col("type").isin("f", "d", "l")
    size = lambda c: long_sum(F.when(c, F.col("size")))
    return with_credit(records).agg(
        F.count("*").alias("entries"), F.count_if(kind("d")).alias("dirs"), F.count_if(kind("f")).alias("files"), F.count_if(kind("f") & (F.col("nlink") > 1)).alias("hardlink_files"),
        F.count_if(kind("l")).alias("symlinks"), F.count_if(other).alias("other"), long_sum(F.when(kind("f"), F.col("credited"))).alias("total_bytes"),
        size(kind("d")).alias("dir_bytes"), size(kind("l")).alias("symlink_bytes"), size(other).alias("other_bytes"), size(F.lit(True)).alias("apparent_bytes"),
    )


def merged_timing(timings: DataFrame) -> DataFrame:
    """start, end, elapsed of crawls read together: of one its own elapsed time, of several the span (the
    longest elapsed time if that is not positive). Rows without a start or with an end before it do not count."""
    valid = timings.where("start > 0 AND end >= start")
    out = valid.agg(F.count("*").alias("crawls"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("elapsed").alias("longest"))
    span = (F.col("end") - F.col("start")).cast("double")
    return out.select("crawls", "start", "end", F.when((F.col("crawls") > 1) & (span > 0), span).otherwise(F.col("longest")).alias("elapsed"), (F.col("crawls") > 1).alias("merged"))


def source_label(names: list[str], most: int = 4096) -> str:
    """The sources of a report in one line."""
    label = ";".join(names)
    return label if len(label.encode()) < most else f"{names[0]};… ({len(names)} locations)"
