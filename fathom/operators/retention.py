"""What a retention rule would delete."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.paths import ancestors, last_name, slashes, under
from fathom.schema import DAY


def eligible(basis: str, days: int, now: int):
    """Times are signed here: what is before 1970 is old."""
    if basis not in ("atime", "mtime", "ctime"):
        raise ValueError("basis must be atime, mtime or ctime")
    if not 1 <= days <= 365000:
        raise ValueError("days must be 1 to 365000")
    return F.col(basis) <= now - days * DAY


def candidates(records: DataFrame, root: str, basis: str | None = None, days: int = 0, now: int = 0) -> DataFrame:
    """Everything under root but directories and names "." and "..", old enough if a basis is given."""
    safe = ~last_name(F.col("path")).isin(".", "..")
    mine = records.where((F.col("type") != "d") & under(F.col("path"), F.lit(root)) & safe)
    return mine if basis is None else mine.where(eligible(basis, days, now))


def empty_directories(records: DataFrame, root: str, basis: str | None = None, days: int = 0, now: int = 0) -> DataFrame:
    """Directories below root with nothing left in them, however deep, once the candidates are gone: the
    greatest depth goes first, then the order of path (rows are in no order). Directories are those recorded
    and those that paths pass through."""
    inside = records.where(under(F.col("path"), F.lit(root)))
    up = ancestors(F.col("path"))
    above = lambda rows: rows.select(F.explode(F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0)))).alias("path"))
    dirs = above(inside).unionByName(inside.where("type = 'd'").select("path")).distinct().where(under(F.col("path"), F.lit(root)) & (F.col("path") != root))
    kept = inside.where(F.col("type") != "d")
    kept = kept.where(F.lit(False)) if basis is None else kept.where(~eligible(basis, days, now))
    return dirs.join(above(kept).distinct(), "path", "left_anti").select("path", slashes(F.col("path")).alias("depth"))


def summary(records: DataFrame, root: str, basis: str | None = None, days: int = 0, now: int = 0) -> DataFrame:
    inside = records.where(under(F.col("path"), F.lit(root)))
    old = F.lit(True) if basis is None else eligible(basis, days, now)
    return inside.agg(F.count("*").alias("walk_entries"), F.count_if(F.col("type") == "d").alias("dirs_seen"), F.count_if(F.col("type") != "d").alias("files_seen"), F.count_if((F.col("type") != "d") & old & ~last_name(F.col("path")).isin(".", "..")).alias("would_delete"))


def remove(found: DataFrame, basis: str | None = None, days: int = 0, now: int = 0) -> DataFrame:
    """Deletes the files of candidates(), on a file system that all executors mount: path and what became of
    each, deleted, kept or error. A crawl may be old: what is a directory by now, or has been touched since, is
    kept; what is gone already counts as deleted, so that a task may run again."""
    if basis is not None:
        eligible(basis, days, now)  # checks the arguments
    time_of, latest = f"st_{basis}", now - days * DAY

    def one(path: str) -> str:
        try:
            s = os.lstat(path)
            if stat.S_ISDIR(s.st_mode) or (basis is not None and int(getattr(s, time_of)) > latest):
                return "kept"
            os.unlink(path)
        except FileNotFoundError:
            return "deleted"
        except (OSError, ValueError):
            return "error"
        return "deleted"

    return found.select("path").mapInArrow(_each(one), "path string, outcome string")


def remove_directories(empty: DataFrame) -> tuple[int, int]:
    """Removes empty_directories(), deepest first, those of one depth at once; a directory that is not empty
    stays. Returns how many went and how many could not."""

    def one(path: str) -> str:
        try:
            os.rmdir(path)
        except FileNotFoundError:
            return "deleted"
        except (OSError, ValueError):
            return "error"
        return "deleted"

    gone = failed = 0
    for (depth,) in empty.select("depth").distinct().orderBy(F.desc("depth")).collect():  # one row a depth
        for r in empty.where(F.col("depth") == depth).select("path").mapInArrow(_each(one), "path string, outcome string").groupBy("outcome").count().collect():
            gone, failed = (gone + r["count"], failed) if r.outcome == "deleted" else (gone, failed + r["count"])
    return gone, failed


def _each(one):
    """mapInArrow function: path -> path and one(path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(p) for p in b.column(0).to_pylist()], pa.string())], ["path", "outcome"])

    return run
