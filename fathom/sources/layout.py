"""The written layout of records: Parquet in folders by owner shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.buckets import uid_shard
from fathom.schema import UID_SHARDS


def write_records(records: DataFrame, folder: str, shards: int = UID_SHARDS) -> None:
    """Sorted by owner inside each shard's folder. A shard of one owner with very many records is written by
    several tasks: ranges end inside it."""
    if shards & (shards - 1) or shards < 1:
        raise ValueError("the number of shards must be a power of two")
    placed = records.withColumn("uid_shard", uid_shard(F.col("uid"), shards))
    placed.repartitionByRange("uid_shard", "uid", "path").sortWithinPartitions("uid_shard", "uid").write.mode("overwrite").partitionBy("uid_shard").parquet(folder)


def of_owner(records: DataFrame, uid: int, shards: int = UID_SHARDS) -> DataFrame:
    """One owner's records: the shard's folder alone is read, which the filter on uid would not imply."""
    return records.where((F.col("uid_shard") == (uid & (shards - 1))) & (F.col("uid") == uid)).drop("uid_shard")


def read_all(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Several crawls as one: a plain union; links are credited once over all of them."""
    return union_all([spark.read.parquet(folder) for folder in folders])


def union_all(crawls: list[DataFrame]) -> DataFrame:
    if not crawls:
        raise ValueError("no crawl to read")
    out = crawls[0]
    for one in crawls[1:]:
        out = out.unionByName(one, allowMissingColumns=True)
    return out
