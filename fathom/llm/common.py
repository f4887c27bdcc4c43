"""What the corpus operators share: shared-folder tables, components, Arrow helpers, packed integers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python: bounds a worker's memory by a few hundred texts.
ARROW_ROWS = 512


#: Bytes of a row group that a writing task gathers.
ROW_GROUP = 16 << 20


def trim() -> None:
    """Gives memory that a worker has freed back to the system: workers live on between tasks, and what one
    step has used would stand beside the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hoard() -> None:
    """Lets a worker keep what it frees until trim(), 64 MB at most: arrays of some MB that are made again and again
    would else be mapped and cleared by the system each time."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


#: What a worker made last and keeps for its next task of the same step, by name. Executors deal tasks to all
#: workers they have ever needed at once, in turn, so several times the running ones may keep something.
_kept: dict[str, object] = {}


def kept(name: str, make):
    """What make() returns, made once by each worker."""
    if name not in _kept:
        release()
        _kept[name] = make()
        trim()
    return _kept[name]


def release() -> None:
    """Lets go what a worker keeps for another step."""
    if _kept:
        _kept.clear()
        trim()


def tune(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that a worker never holds many long texts at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = tempfile.mkdtemp(prefix="fathom-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost
    executors, and fixes the rows that several later steps read. Deleted when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathom-{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of what df reads: of files their sizes, wherever they are stored, and whatever columns are
    taken. Of what has no known size half its texts' bytes, counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=0) < 1 << 55:
        return sum(sizes)
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 if "text" in df.columns else 0


def parts_for(df: DataFrame, each: int = 12 << 20) -> int:
    """Partitions so that each gets about `each` bytes of df; no fewer than the shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(max(least, input_bytes(df) // each + 1), 1 << 20))


#: Bytes, at least and on average, of what a block of the input sends to one hash range.
ROW_BYTES = 1024


def block_bytes(df: DataFrame, least: int) -> int:
    """Bytes of a block, where every block sends a row to every hash range of as many bytes: `least`, or what
    keeps the rows so large that their number grows with the input and not with its square. A block then grows
    with the input's square root (least = 5 MB holds up to 25 GB; 1 TB: 32 MB, 100 TB: 320 MB)."""
    return max(least, math.isqrt(input_bytes(df) * ROW_BYTES))


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, component): the smallest id that each vertex of the edges reaches.

    Each round hooks every vertex to its smallest neighbour, shortens that once (the neighbour's smallest
    neighbour), and contracts the edges: what became one vertex leaves no edge behind, so the edges shrink
    quickly and the rounds number about the logarithm of a component's width. Each round's tables are
    written to the shared folder; only one number, of edges left, comes to the driver. No edges: no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialise(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = None
    while True:
        hook = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "hooks")
        step = hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", "q")
        if labels is None:
            labels = step.select(F.col("u").alias("id"), F.col("q").alias("component"))
        else:
            labels = labels.join(step.withColumnRenamed("u", "component"), "component", "left").select("id", F.coalesce("q", "component").alias("component"))
        labels = materialise(labels, "labels")
        both = both.join(step, "u").select("v", F.col("q").alias("a")).join(step.withColumnRenamed("u", "v"), "v").select(F.col("a").alias("u"), F.col("q").alias("v"))
        both = materialise(both.where("u <> v").distinct(), "edges")
        if not both.limit(1).count():
            return labels


# ---------------------------------------------------------------- Arrow and numpy


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts, A-Z lower-cased: all words as a dictionary array, and
    how many each text has. Null texts have none."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))  # string kernels need an array that starts at its buffers' start
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.values
    counts = np.diff(lists.offsets.to_numpy())
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.sum(full).as_py() != len(flat):
        keep = full.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(keep)])
        off = np.concatenate([[0], np.cumsum(counts)])
        counts = np.diff(ends[off])
        flat = flat.filter(full)
    return flat.dictionary_encode(), counts.astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once."""
    import pandas as pd

    values = words.dictionary.to_numpy(zero_copy_only=False)
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(values, dtype=object), categorize=False)[words.indices.to_numpy()]


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending uint64s as gaps, each in as few bytes as the largest gap needs (the first byte says how
    many); the highest bytes, which are small numbers, are Huffman-coded."""
    if not len(sorted_values):
        return b""
    gaps = np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    wide = max(1, (int(np.diff(sorted_values, prepend=np.uint64(0)).max()).bit_length() + 7) // 8)
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    top = squeeze.compress(np.ascontiguousarray(gaps[:, wide - 1]).tobytes()) + squeeze.flush()
    return b"".join([bytes([wide]), len(gaps).to_bytes(4, "little"), np.ascontiguousarray(gaps[:, : wide - 1]).tobytes(), top])


def unpack(data: bytes) -> np.ndarray:
    """The reverse of pack()."""
    if not data:
        return np.zeros(0, np.uint64)
    wide, n = data[0], int.from_bytes(data[1:5], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, : wide - 1] = np.frombuffer(data, np.uint8, n * (wide - 1), 5).reshape(n, wide - 1)
    out[:, wide - 1] = np.frombuffer(zlib.decompress(data[5 + n * (wide - 1) :], -15), np.uint8)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def bucket_edges(n: int) -> np.ndarray:
    """Starts of n equal ranges of 64-bit hashes."""
    return np.array([b * (1 << 64) // n for b in range(n)], dtype=np.uint64)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


#: Columns whose types operators rely on.
KINDS = {"doc_id": "long", "vec_id": "long", "text": "string", "toxic": "int"}


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name do no harm."""
    return df.select(*[(F.col(f"`{n}`").cast(KINDS[n]) if n in KINDS else F.col(f"`{n}`")).alias(n) for n in names])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
