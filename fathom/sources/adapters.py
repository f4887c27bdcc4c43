"""Other tables read as crawl records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2001-12-01 UTC: the time that reports over these records go by.
NOW = 1007164800


def lineitem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a file of a made-up storage system."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    n, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    shipped = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    part, supplier = F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")
    size = (
        F.when(n == 1, F.floor(cents / 100)).when(n == 2, cents * 10).when(n == 3, cents * 100).when(n == 4, cents * 1000)
        .when(n == 5, cents * 10000).when(n == 6, F.floor(cents / 1000)).otherwise(F.lit(0))
    )
    path = F.concat(F.lit("/srv/proj"), (supplier % 7).cast("string"), F.lit("/"), "l_returnflag", "l_linestatus", F.lit("/Order_"), F.col("l_orderkey").cast("string"), F.lit("/part_"), part.cast("string"), F.lit(".dat"))
    return li.select(
        path.alias("path"), F.when(quantity == 1, "d").when(quantity == 2, "l").when(quantity == 3, "p").otherwise("f").alias("type"),
        (supplier + 1000).alias("uid"), (supplier % 10 + 100).alias("gid"), size.cast("long").alias("size"), part.alias("inode"),
        F.lit(8).alias("dev_major"), (supplier % 3).cast("int").alias("dev_minor"), F.when(n.isin(2, 6), F.lit(2)).otherwise(F.lit(1)).cast("long").alias("nlink"),
        (shipped + part % 400 * 86400).alias("atime"), shipped.alias("mtime"), (shipped + supplier % 13 * 60 * 86400).alias("ctime"), F.col("l_orderkey").cast("long").alias("source_key"),
    )


#: The same in DuckDB's SQL.
LINEITEM_SQL = """crawl AS (SELECT '/srv/proj' || (l_suppkey % 7) || '/' || l_returnflag || l_linestatus || '/Order_' || l_orderkey || '/part_' || l_partkey || '.dat' AS path,
 CASE l_quantity::INT WHEN 1 THEN 'd' WHEN 2 THEN 'l' WHEN 3 THEN 'p' ELSE 'f' END AS type,
 (1000 + l_suppkey)::BIGINT AS uid, (100 + l_suppkey % 10)::BIGINT AS gid,
 (CASE l_linenumber WHEN 1 THEN cents // 100 WHEN 2 THEN cents * 10 WHEN 3 THEN cents * 100 WHEN 4 THEN cents * 1000 WHEN 5 THEN cents * 10000 WHEN 6 THEN cents // 1000 ELSE 0 END)::BIGINT AS size,
 l_partkey::BIGINT AS inode, 8 AS dev_major, (l_suppkey % 3)::INT AS dev_minor, (CASE WHEN l_linenumber IN (2, 6) THEN 2 ELSE 1 END)::BIGINT AS nlink,
 (ship + (l_partkey % 400) * 86400)::BIGINT AS atime, ship AS mtime, (ship + (l_suppkey % 13) * 60 * 86400)::BIGINT AS ctime, l_orderkey::BIGINT AS source_key
 FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS cents, epoch(l_shipdate::TIMESTAMP)::BIGINT AS ship FROM lineitem))"""
