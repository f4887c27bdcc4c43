"""Bytes are credited to one link of an inode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["dev_major", "dev_minor", "inode"]
#: Who gets the bytes, where links differ: the first in this order.
ORDER = ["path", "size", "mtime", "atime", "ctime"]


def with_credit(records: DataFrame) -> DataFrame:
    """Adds `credited`: the bytes that a record adds to totals. Of a file with several links only the first
    of its inode has its size, the others 0; everything else has its own size, as have records whose type or
    link count is null. Only files with nlink > 1 are shuffled."""
    linked = F.coalesce((F.col("type") == "f") & (F.col("nlink") > 1), F.lit(False))
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)) == 1
    several = records.where(linked).withColumn("credited", F.when(first, F.col("size")).otherwise(F.lit(0)).cast("long"))
    return records.where(~linked).withColumn("credited", F.col("size")).unionByName(several)


def winners(records: DataFrame) -> DataFrame:
    """Of each inode with several links the record that gets the bytes (WindowGroupLimit cuts before the shuffle)."""
    linked = records.where((F.col("type") == "f") & (F.col("nlink") > 1))
    return linked.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER))).where("nth = 1").drop("nth")
