"""Checks and mends shards in the packed format, on a file system that all executors mount."""

from __future__ import annotations

import mmap
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources.shards import HEADER, MAGIC, OLD_MAGIC, OLD_VERSION, VERSION, local, read_sidecar, scan, sidecar

REPORT = "name string, size long, records long, good_end long, header string, status string, sidecar_ok boolean"
ARROW = pa.schema([("name", pa.string()), ("size", pa.int64()), ("records", pa.int64()), ("good_end", pa.int64()), ("header", pa.string()), ("status", pa.string()), ("sidecar_ok", pa.bool_())])
SHARD = re.compile(r"uid_shard_[0-9]+\.bin")


def judge(data) -> tuple[int, int, str, str]:
    """(records, end of the last whole one, header, status). A file too short for a header is quarantined; a
    torn tail is cut; an old or unknown header before whole records is rewritten."""
    if len(data) < HEADER.size:
        return 0, 0, "short", "quarantine"
    magic, version, _ = HEADER.unpack_from(data)
    header = {(MAGIC, VERSION): "current", (OLD_MAGIC, OLD_VERSION): "old"}.get((magic, version), "unknown")
    _, end, n = scan(data)
    if end < len(data):
        return n, end, header, "truncate"
    return n, end, header, "ok" if header == "current" else "header_rewrite"


@contextmanager
def mapped(path: str):
    """A file's bytes, paged in as they are read: shards may be larger than memory."""
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            yield b""
            return
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield data


def shard_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each shard file, sorted by name; each file is one task's row. No shards: no rows."""
    folder = local(folder)
    names = sorted(n for n in os.listdir(folder) if SHARD.fullmatch(n))

    def row(name: str) -> tuple:
        with mapped(f"{folder}/{name}") as data:
            records, end, header, status = judge(data)
            size = len(data)
        try:
            with open(f"{folder}/{name}.ckpt", "rb") as f:
                side = read_sidecar(f.read(), size)
        except OSError:
            side = None
        return name, size, records, end, header, status, side is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(n) for n in b.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), 10_000)))
    return files.mapInArrow(run, REPORT).orderBy("name")


def tail_summary(report: DataFrame) -> DataFrame:
    """What cutting torn tails removes."""
    cut = report.where("status = 'truncate'")
    return cut.agg(F.count("*").alias("shards"), F.coalesce(F.sum(F.col("size") - F.col("good_end")), F.lit(0)).cast("long").alias("bytes_removed"), F.coalesce(F.sum("size"), F.lit(0)).alias("old_bytes"), F.coalesce(F.sum("good_end"), F.lit(0)).alias("new_bytes"))


def unready(spark: SparkSession, folder: str) -> list[str]:
    """Names of the shards that a report could not read whole: damaged, of another header, or without a valid
    sidecar. What a repair ends with."""
    return [r.name for r in shard_report(spark, folder).where("status <> 'ok' OR NOT sidecar_ok").collect()]  # one row a file


def quarantine(folder: str, name: str) -> str:
    """Moves a shard, and its sidecar, to corrupt_shards/; a name that is taken gets a number."""
    to = f"{folder}/corrupt_shards"
    os.makedirs(to, exist_ok=True)
    target, k = name, 0
    while os.path.exists(f"{to}/{target}"):
        k += 1
        target = f"{name}.{k}"
    os.replace(f"{folder}/{name}", f"{to}/{target}")
    if os.path.exists(f"{folder}/{name}.ckpt"):
        os.replace(f"{folder}/{name}.ckpt", f"{to}/{target}.ckpt")
    return target


def repair(spark: SparkSession, folder: str, dry_run: bool = True) -> list[dict]:
    """What was (or would be) done to each shard. Acts on the driver, file by file; a shard that cannot be
    written has its error, and the others go on."""
    folder, done = local(folder), []
    for r in shard_report(spark, folder).collect():  # one row for each file
        done.append({"name": r.name, "status": r.status, "records": r.records, "error": None})
        if dry_run:
            continue
        try:
            mend(folder, r)
        except OSError as e:
            done[-1]["error"] = str(e)
    return done


def mend(folder: str, r) -> None:
    """Does to one shard what its row of the report says."""
    path = f"{folder}/{r.name}"
    if r.status == "quarantine":
        quarantine(folder, r.name)
        return
    if r.status == "ok" and r.sidecar_ok:
        return
    if r.status != "ok":
        with open(path, "r+b") as f:
            if r.status == "truncate":
                f.truncate(max(r.good_end, HEADER.size))
            if r.header != "current":
                f.write(HEADER.pack(MAGIC, VERSION, 0))
    with mapped(path) as data:
        starts = scan(data)[0]
    with open(path + ".ckpt.part", "wb") as f:
        f.write(sidecar(starts))
    os.replace(path + ".ckpt.part", path + ".ckpt")
