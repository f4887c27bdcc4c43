"""Substring search over path names, with a trigram index that pays once it is written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.paths import LOWER, UPPER, ascii_lower, path_trigrams

BUCKET_SHIFT = 18  # 64 folders of postings


def term_of(term: str) -> str:
    if len(term.encode()) < 3:
        raise ValueError("a search term has 3 bytes at least")
    return term.translate(str.maketrans(UPPER, LOWER))


def matches(paths: DataFrame, term: str, column: str = "path") -> DataFrame:
    """Rows whose path holds the term inside one name, whatever the case of A-Z: the plain scan. A term with
    a slash is in no name."""
    low = term_of(term)
    return paths.where(F.lit(False) if "/" in low else F.contains(ascii_lower(F.col(column)), F.lit(low)))


def page(found: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of matches in the order of path_id, each with the number of all matches."""
    if limit < 1 or skip < 0:
        raise ValueError("limit must be positive and skip not negative")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("path_id").offset(skip).limit(limit).crossJoin(F.broadcast(total))


def numbered(records: DataFrame) -> DataFrame:
    """Dense path_ids in the order of path, type, inode and size, without one task that sees all rows: ranges
    are sorted on their own and begin where the ranges before them end."""
    keys = ["path", "type", "inode", "size"]
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = records.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    own = F.monotonically_increasing_id()
    placed = ranged.select("path", F.shiftright(own, 33).alias("part"), own.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    starts = placed.groupBy("part").agg((F.max("nth") + 1).alias("n"))
    starts = starts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # one row for each range
    return placed.join(F.broadcast(starts), "part").select((F.col("start") + F.col("nth")).alias("path_id"), "path")


def postings(paths: DataFrame) -> DataFrame:
    """trigram, path_id: each distinct window of each path once."""
    return paths.select("path_id", F.explode(path_trigrams(F.col("path"))).alias("trigram")).select("trigram", "path_id")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file, wherever it is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class PathIndex:
    """A written index: paths, postings in folders by trigram, and one row of counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, records: DataFrame, folder: str, uid: int | None = None) -> PathIndex:
        spark = records.sparkSession
        mine = records if uid is None else records.where(F.col("uid") == uid)
        numbered(mine).write.mode("overwrite").parquet(f"{folder}/paths")
        return cls.resume(spark, folder)

    @classmethod
    def resume(cls, spark: SparkSession, folder: str) -> PathIndex:
        """Postings and counts from paths that are written already: what is left of a build that stopped."""
        if not exists(spark, f"{folder}/paths/_SUCCESS"):
            raise ValueError(f"no whole list of paths in {folder}")
        paths = spark.read.parquet(f"{folder}/paths")
        posts = postings(paths).withColumn("bucket", F.shiftright("trigram", BUCKET_SHIFT))
        # a trigram's list may be long: several files for each folder, sorted so that row groups can be skipped
        posts.repartitionByRange("bucket", "trigram", "path_id").sortWithinPartitions("bucket", "trigram", "path_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        written = spark.read.parquet(f"{folder}/postings")
        meta = paths.agg(F.count("*").alias("indexed_paths")).crossJoin(written.agg(F.count("*").alias("trigram_records"), F.count_distinct("trigram").alias("unique_trigrams")))
        meta.write.mode("overwrite").json(f"{folder}/meta")
        return cls(spark, folder)

    def meta(self) -> dict:
        """The counts; 0 where none are written."""
        none = {"indexed_paths": 0, "trigram_records": 0, "unique_trigrams": 0}
        if not exists(self.spark, f"{self.folder}/meta/_SUCCESS"):
            return none
        row = self.spark.read.json(f"{self.folder}/meta").first()
        return row.asDict() if row else none

    def candidates(self, term: str) -> DataFrame:
        """path_ids that hold all trigrams of the term."""
        data = term_of(term).encode()
        grams = sorted({data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)})
        posts = self.spark.read.parquet(f"{self.folder}/postings")
        asked = posts.where(F.col("bucket").isin(sorted({g >> BUCKET_SHIFT for g in grams})) & F.col("trigram").isin(grams))
        return asked.groupBy("path_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("path_id")

    def search(self, term: str) -> DataFrame:
        """path_id, path of all matches; candidates are verified."""
        paths = self.spark.read.parquet(f"{self.folder}/paths")
        return matches(paths.join(self.candidates(term), "path_id", "left_semi"), term).select("path_id", "path")

    def answer(self, term: str, skip: int = 0, limit: int = 50) -> str:
        """One JSON object, as the HTTP front end returns it."""
        found, meta = self.search(term).cache(), self.meta()
        rows = [r.path for r in found.orderBy("path_id").offset(skip).limit(limit).collect()]
        out = {"total": found.count(), "skip": skip, "limit": limit, "index_keys": meta["unique_trigrams"], "indexed_paths": meta["indexed_paths"], "paths": rows}
        found.unpersist()
        return json.dumps(out, ensure_ascii=False)
