"""The crawl record and the fixed values of its analyses."""

from __future__ import annotations

from pyspark.sql import types as T

DAY = 86400

RECORD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("type", T.StringType()), T.StructField("mode", T.IntegerType()),
    T.StructField("uid", T.LongType()), T.StructField("gid", T.LongType()), T.StructField("size", T.LongType()), T.StructField("inode", T.LongType()),
    T.StructField("dev_major", T.IntegerType()), T.StructField("dev_minor", T.IntegerType()), T.StructField("nlink", T.LongType()),
    T.StructField("atime", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("ctime", T.LongType()),
])

# Bucket bounds (exclusive upper ends), their labels, and the thresholds of the badges.
SIZE_BOUNDS = [4096, 1048576, 104857600, 1073741824, 10737418240]
SIZE_LABELS = ["< 4K", "4K – 1M", "1M – 100M", "100M – 1G", "1G – 10G", "10G+"]
AGE_BOUNDS_DAYS = [30, 90, 180, 365, 1095]
AGE_LABELS = ["< 30 days", "30–90 days", "90–180 days", "180 days – 1 yr", "1–3 years", "3+ years"]
CHANGE_LED_SECONDS = 180 * DAY
BADGE_PERCENT = 30
TOP_ROWS = 200
MOST_LEVELS = 32
UID_SHARDS = 8192

BASES = ("atime", "mtime", "ctime", "effective")
