"""key=value files, and the names of owners."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = ("format_version", "uid_shards", "uid_shard_digits", "crawl_started_epoch", "crawl_finished_epoch")


def read_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each manifest: its pairs as a map, the shard count, the label that reports show, the times."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").contains("="))
    at = F.instr("value", "=")
    pairs = lines.select("file", F.col("value").substr(F.lit(1), at - 1).alias("k"), F.col("value").substr(at + 1, F.length("value")).alias("v"))
    maps = pairs.groupBy("file").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("k", "v")))).alias("pairs"))
    long_of = lambda k: F.try_element_at("pairs", F.lit(k)).try_cast("long")
    text = lambda k: F.try_element_at("pairs", F.lit(k))
    return maps.select(
        "file", "pairs", F.when(text("layout") == "uid_shards", long_of("uid_shards")).alias("uid_shards"), F.coalesce(text("record_root"), text("start_path")).alias("label"),
        long_of("crawl_started_epoch").alias("start"), long_of("crawl_finished_epoch").alias("end"), text("crawl_elapsed_sec").try_cast("double").alias("elapsed"),
    )


def one_layout(manifests: DataFrame) -> int | None:
    """The shard count that all crawls agree on (None: not sharded); anything else is an error."""
    counts = [r.uid_shards for r in manifests.select("uid_shards").distinct().limit(3).collect()]
    if len(counts) > 1:
        raise ValueError("the crawls differ in layout or number of shards")
    n = counts[0] if counts else None
    if n is not None and (n < 1 or n & (n - 1)):
        raise ValueError("the number of shards must be a power of two")
    return n


def manifest_text(start_path: str, shards: int, started: float, finished: float, record_root: str | None = None) -> str:
    rows = {"format_version": 3, "layout": "uid_shards", "seed_mode": "root_only", "start_path": start_path}
    if record_root:
        rows["record_root"] = record_root
    rows |= {"uid_shards": shards, "uid_shard_digits": len(str(shards - 1)), "crawl_started_epoch": int(started), "crawl_finished_epoch": int(finished), "crawl_elapsed_sec": f"{finished - started:.3f}"}
    return "".join(f"{k}={v}\n" for k, v in rows.items())


def owner_names(spark: SparkSession, path: str) -> DataFrame:
    """uid, name from lines "<id> <name>"; the first name of an id holds."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    split = lines.select(F.regexp_extract("value", r"^(\d+) ", 1).try_cast("long").alias("uid"), F.regexp_extract("value", r"^\d+ (.*)$", 1).alias("name"), "n").where("uid IS NOT NULL")
    return split.groupBy("uid").agg(F.min_by("name", "n").alias("name"))


def default_folder(host: str, at: float | None = None) -> str:
    return f"{host}_{time.strftime('%b-%d-%Y_%H-%M-%S', time.gmtime(at)).lower()}"
