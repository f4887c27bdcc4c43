"""A directory tree as crawl records."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fathom.schema import RECORD
from fathom.sources.shards import ARROW

KINDS = {stat.S_IFREG: "f", stat.S_IFDIR: "d", stat.S_IFLNK: "l", stat.S_IFCHR: "c", stat.S_IFBLK: "b", stat.S_IFIFO: "p", stat.S_IFSOCK: "s"}


def record(path: str, s: os.stat_result) -> tuple:
    return (printable(path), KINDS.get(stat.S_IFMT(s.st_mode), "o"), s.st_mode, s.st_uid, s.st_gid, s.st_size, s.st_ino, os.major(s.st_dev), os.minor(s.st_dev), s.st_nlink, int(s.st_atime), int(s.st_mtime), int(s.st_ctime))


def printable(path: str) -> str:
    """A path as UTF-8 text: bytes of a name that are none are written as \\xNN."""
    return os.fsencode(path).decode("utf-8", "backslashreplace")


def walk(top: str, failed=None) -> Iterator[tuple]:
    """Everything at and below top; symbolic links are recorded, not followed; what cannot be read is left out,
    and failed() called for it."""
    stack = [top]
    while stack:
        here = stack.pop()
        try:
            s = os.lstat(here)
            yield record(here, s)
            if stat.S_ISDIR(s.st_mode):
                stack.extend(e.path for e in os.scandir(here))
        except OSError:
            if failed:
                failed()


def crawl(spark: SparkSession, root: str, spread: int = 64, errors=None) -> DataFrame:
    """Records of a tree that all executors mount. The driver opens directories, breadth first, until there
    are `spread` subtrees; each is a task's. errors: an accumulator that counts what could not be read; it is
    right where the result is evaluated once."""
    failed = None if errors is None else lambda: errors.add(1)
    root = root.rstrip("/") or "/"
    done, level = [], [root]
    while level and len(level) < spread:
        below = []
        for d in level:
            try:
                s = os.lstat(d)
                done.append(record(d, s))
                if stat.S_ISDIR(s.st_mode):
                    below += [e.path for e in os.scandir(d)]
            except OSError:
                if failed:
                    failed()
        level = below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for top in b.column(0).to_pylist():
                for r in walk(os.fsdecode(top), failed):
                    rows.append(r)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    out = spark.createDataFrame(done, RECORD)
    if level:
        out = out.unionByName(spark.createDataFrame([(bytearray(os.fsencode(x)),) for x in level], "top binary").repartition(len(level)).mapInArrow(run, RECORD))
    return out
