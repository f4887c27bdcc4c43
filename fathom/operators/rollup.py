"""Directory rollups of heat-map cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.paths import below, components, leads, level_rows, under
from fathom.operators.credit import with_credit
from fathom.operators.heatmap import bucketed
from fathom.schema import MOST_LEVELS, TOP_ROWS

CELL = ["age_bucket", "size_bucket"]


def base_prefixes(files: DataFrame) -> DataFrame:
    """The directory that all paths of a cell share (at most 36 rows). The longest common prefix of a set is
    that of its least and greatest; it is cut back to its directory if it ends inside a name. A cell of one
    path has that path itself."""
    ends = files.groupBy(*CELL).agg(F.min("path").alias("a"), F.max("path").alias("b"))
    same = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length("a"), F.length("b"))), lambda i: F.col("a").substr(F.lit(1), i) == F.col("b").substr(F.lit(1), i)))
    common = F.col("a").substr(F.lit(1), same)
    common = F.when(common.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(common, "/+$", ""))
    lcp = ends.select(*CELL, common.alias("common"), F.col("a"))
    whole = files.join(F.broadcast(lcp), CELL).groupBy(*CELL).agg(F.first("common").alias("common"), F.first("a").alias("a"), F.bool_and(under(F.col("path"), F.col("common"))).alias("whole"))
    up = F.regexp_replace("common", "/[^/]*$", "")
    cut = F.when(F.col("common").contains("/"), F.when(up == "", F.lit("/")).otherwise(up)).when(F.col("a").startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return whole.select(*CELL, F.when(F.col("whole"), F.col("common")).otherwise(cut).alias("base"))


def rollup(records: DataFrame, now: int, basis: str = "effective", levels: int = 3) -> DataFrame:
    """For each cell and each of the first `levels` names below its base: files and bytes of the cell, and of
    everything below the same row path, counted at the depths that the rows have."""
    if not 1 <= levels <= MOST_LEVELS:
        raise ValueError(f"levels must be 1 to {MOST_LEVELS}")
    files = bucketed(records, now, basis)
    bases = F.broadcast(base_prefixes(files))
    named = files.join(bases, CELL).select(*CELL, "credited", "led", "base", components(below(F.col("path"), F.col("base"))).alias("names"))
    rows = named.select(*CELL, "credited", "led", F.explode(level_rows(F.col("names"), F.col("base"), levels)).alias("row"))
    mine = rows.groupBy(*CELL, F.col("row.level").alias("level"), F.col("row.row_path").alias("row_path")).agg(
        F.count("*").alias("bucket_files"), F.sum("credited").alias("bucket_bytes"), F.count_if("led").alias("led_files"),
        F.sum(F.when(F.col("led"), F.col("credited")).otherwise(F.lit(0))).cast("long").alias("led_bytes"),
    )
    deepest = F.size(components(F.col("row_path")))
    bounds = mine.agg(F.min(deepest).alias("low"), F.max(deepest).alias("high"))
    every = with_credit(records).select("type", "credited", components(F.col("path")).alias("names")).crossJoin(F.broadcast(bounds))  # one row
    every = every.select("type", "credited", F.explode(leads(F.col("names"), F.col("low"), F.col("high"))).alias("row_path"))
    # added up before the shuffle: a directory that holds a large part of all records is one row of each task
    totals = every.groupBy("row_path").agg(F.count_if(F.col("type") == "f").alias("total_files"), F.count_if(F.col("type") == "d").alias("total_dirs"), F.sum("credited").alias("total_bytes"))
    return mine.join(totals, "row_path", "left").na.fill(0, ["total_files", "total_dirs", "total_bytes"])


def top_rows(rolled: DataFrame, most: int = TOP_ROWS) -> DataFrame:
    """The rows that a page shows of each cell and level, by bytes, files and path, with their rank."""
    w = Window.partitionBy(*CELL, "level").orderBy(F.desc("bucket_bytes"), F.desc("bucket_files"), "row_path")
    return rolled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def heat(shown: DataFrame) -> DataFrame:
    """Each shown row against the largest of its page."""
    w = Window.partitionBy(*CELL, "level")
    part = lambda c: F.when(F.max(c).over(w) > 0, F.lit(100.0) * F.col(c) / F.max(c).over(w)).otherwise(F.lit(0.0))
    return shown.withColumns({f"{c}_heat": part(c) for c in ("total_files", "total_dirs", "total_bytes")})


def level_totals(records: DataFrame, level: int) -> DataFrame:
    """Files and bytes below every directory (or file) at one depth from the root."""
    names = components(F.col("path"))
    rows = with_credit(records.where("type = 'f'")).where(F.size(names) >= level)
    return rows.groupBy(F.concat(F.lit("/"), F.array_join(F.slice(names, 1, level), "/")).alias("row_path")).agg(F.count("*").alias("files"), F.sum("credited").alias("bytes"))
