"""Record shards in the packed binary format: 16-byte header, then 80-byte record headers each followed by
the path's bytes; a sidecar `.ckpt` lists record starts at about every 32 MiB."""

from __future__ import annotations

import mmap
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathom.functions.buckets import uid_shard
from fathom.schema import RECORD

# Fixed values of the format.
MAGIC, VERSION = b"ERCBIN03", 3
OLD_MAGIC, OLD_VERSION = b"ERCBIN02", 2
HEADER = struct.Struct("<8sII")
ENTRY = struct.Struct("<HBBIQQQQIIQQQQ")
SIDE_MAGIC, SIDE_VERSION, STRIDE = b"ERCCKPT\0", 1, 32 << 20
SIDE = struct.Struct("<8sIIQQ")

ARROW = pa.schema([("path", pa.string()), ("type", pa.string()), ("mode", pa.int32()), ("uid", pa.int64()), ("gid", pa.int64()), ("size", pa.int64()), ("inode", pa.int64()), ("dev_major", pa.int32()), ("dev_minor", pa.int32()), ("nlink", pa.int64()), ("atime", pa.int64()), ("mtime", pa.int64()), ("ctime", pa.int64())])


def signed(v: int, bits: int) -> int:
    return v - (1 << bits) if v >> (bits - 1) else v


def decode(data: bytes, at: int, end: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Records from `at` on that start before `end`; a torn last record ends it."""
    out: list[tuple] = []
    while at + ENTRY.size <= len(data) and at < end:
        n, kind, _, mode, uid, gid, size, inode, major, minor, nlink, atime, mtime, ctime = ENTRY.unpack_from(data, at)
        if at + ENTRY.size + n > len(data):
            break
        path = data[at + ENTRY.size : at + ENTRY.size + n].decode("utf-8", "backslashreplace")
        out.append((path, chr(kind), signed(mode, 32), signed(uid, 64), signed(gid, 64), signed(size, 64), signed(inode, 64), signed(major, 32), signed(minor, 32), signed(nlink, 64), signed(atime, 64), signed(mtime, 64), signed(ctime, 64)))
        at += ENTRY.size + n
        if len(out) >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)


def encode(rows) -> bytes:
    out = []
    for r in rows:
        path = r["path"].encode()
        if len(path) > 65535:
            raise ValueError(f"the format has 16 bits for a path's length: {len(path)} bytes")
        u = lambda v, bits: (v or 0) & ((1 << bits) - 1)
        out.append(ENTRY.pack(len(path), ord((r.get("type") or "o")[0]), 0, u(r.get("mode"), 32), u(r["uid"], 64), u(r["gid"], 64), u(r["size"], 64), u(r["inode"], 64), u(r["dev_major"], 32), u(r["dev_minor"], 32), u(r["nlink"], 64), u(r["atime"], 64), u(r["mtime"], 64), u(r["ctime"], 64)) + path)
    return b"".join(out)


def header_bytes() -> bytes:
    return HEADER.pack(MAGIC, VERSION, 0)


def scan(data: bytes) -> tuple[list[int], int, int]:
    """(starts for the sidecar, end of the last whole record, number of records)."""
    starts, at, n = [HEADER.size], HEADER.size, 0
    while at < len(data):
        if at - starts[-1] >= STRIDE:
            starts.append(at)
        if at + ENTRY.size > len(data):
            break
        end = at + ENTRY.size + int.from_bytes(data[at : at + 2], "little")
        if end > len(data):
            break
        at, n = end, n + 1
    return starts, min(at, len(data)), n


def sidecar(starts: list[int]) -> bytes:
    return SIDE.pack(SIDE_MAGIC, SIDE_VERSION, 0, STRIDE, len(starts)) + struct.pack(f"<{len(starts)}Q", *starts)


def read_sidecar(data: bytes, size: int) -> list[int] | None:
    """The starts, or None if the sidecar is not valid for a shard of that size."""
    if len(data) < SIDE.size:
        return None
    magic, version, _, _, n = SIDE.unpack_from(data)
    if magic != SIDE_MAGIC or version != SIDE_VERSION or len(data) < SIDE.size + 8 * n or n < 1:
        return None
    starts = list(struct.unpack_from(f"<{n}Q", data, SIDE.size))
    rising = all(a < b for a, b in zip(starts, starts[1:]))
    return starts if starts[0] == HEADER.size and rising and starts[-1] <= size else None


def local(folder: str) -> str:
    return folder.removeprefix("file://").removeprefix("file:")


def write_shards(records: DataFrame, folder: str, shards: int) -> int:
    """Writes shards and sidecars, one task for each shard; returns how many. For exchange with tools that
    read the format; queries read Parquet."""
    folder = local(folder)
    digits = len(str(shards - 1))
    os.makedirs(folder, exist_ok=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, object] = {}
        attempt = uuid.uuid4().hex  # two attempts of a task never write to one file
        for b in batches:
            by: dict[int, list] = {}
            for r in b.to_pylist():
                by.setdefault(r["uid_shard"], []).append(r)
            for k, rows in by.items():
                name = f"{folder}/uid_shard_{k:0{digits}d}.bin"
                f = names.get(k)
                if f is None:
                    f = names[k] = open(f"{name}.{attempt}.part", "wb")
                    f.write(header_bytes())
                f.write(encode(rows))
        for k, f in names.items():
            f.close()
            name = f"{folder}/uid_shard_{k:0{digits}d}.bin"
            with open(f.name, "rb") as g, mmap.mmap(g.fileno(), 0, access=mmap.ACCESS_READ) as data:
                starts = scan(data)[0]
            with open(f"{name}.ckpt.{attempt}.part", "wb") as g:
                g.write(sidecar(starts))
            os.replace(g.name, name + ".ckpt")
            os.replace(f.name, name)  # a task that is run again leaves whole files
        yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.int32())], ["shard"])

    return records.withColumn("uid_shard", uid_shard(F.col("uid"), shards).cast("int")).repartition(shards, "uid_shard").mapInArrow(put, "shard int").count()


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.uid = local(options["path"]), options.get("uid")
        self.shards = int(options.get("shards", 0))

    def partitions(self) -> list[Part]:
        names = sorted(n for n in os.listdir(self.folder) if n.startswith(("uid_shard_", "thread_")) and n.endswith(".bin"))
        if self.uid and self.shards:  # one owner is in one shard
            own = int(self.uid) & (self.shards - 1)
            names = [n for n in names if n.startswith("uid_shard_") and int(n[10:-4]) == own]
        parts = []
        for n in names:
            path = f"{self.folder}/{n}"
            size = os.path.getsize(path)
            try:
                with open(path + ".ckpt", "rb") as f:
                    starts = read_sidecar(f.read(), size)
            except OSError:
                starts = None
            with open(path, "rb") as f:
                head = f.read(HEADER.size)
            if starts and len(head) == HEADER.size and HEADER.unpack(head)[:2] == (MAGIC, VERSION):  # others have no rows
                parts += [Part(path, a, b) for a, b in zip(starts, [*starts[1:], size]) if a < b]
        return parts or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with open(partition.path, "rb") as f:
                f.seek(partition.start)
                data = f.read(partition.end - partition.start)
            yield from decode(data, 0, len(data))


class ShardSource(DataSource):
    """spark.read.format("crawlshards").load(folder); options uid and shards read one owner's shard alone."""

    @classmethod
    def name(cls) -> str:
        return "crawlshards"

    def schema(self):
        return RECORD

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)


def read_shards(spark: SparkSession, folder: str, uid: int | None = None, shards: int | None = None) -> DataFrame:
    spark.dataSource.register(ShardSource)
    reader = spark.read.format("crawlshards")
    if uid is not None:
        reader = reader.option("uid", str(uid))
        if shards:
            reader = reader.option("shards", str(shards))
    out = reader.load(folder)
    return out if uid is None else out.where(F.col("uid") == uid)
