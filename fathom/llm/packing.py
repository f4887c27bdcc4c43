"""Best-fit packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing looks only at lengths, and there are at most `capacity` of them. So the pieces are
counted by length (a table of bounded size), the bins are filled once on the driver by best-fit decreasing
with a segment tree over remaining capacities, and the result is a bounded list of rules "pieces number a
to b of length l go to bins from c on, at this offset". Every piece finds its place by its number among the
pieces of its length. That is exactly the packing that best-fit decreasing gives piece by piece over the
whole corpus, whatever its size; no shard of its own, no group in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, materialise, need, trim, tune
from .tokens import encoder

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
RULES = "length int, first long, last long, bin long, each int, at int"


class CapacityTree:
    """How many groups of open bins have each remaining capacity; finds the tightest that fits in
    logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least `least`."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.count[2 * i])
                return i - self.size
            i >>= 1
        return None


def best_fit_rules(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for counts[length] pieces of each length: rows (length, first, last, bin, each,
    at): pieces number first..last-1 of that length fill bins bin, bin+1, ..., `each` pieces a bin, one
    after the other from offset `at`."""
    tree, open_bins, rules, new = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins[room].append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, new, -(-(total - done) // (capacity // length))
                new += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -1)
            # the tightest bin stays the tightest until the next piece no longer fits
            each = room // length
            full = min(n, (total - done) // each)
            if full:
                rules.append((length, done, done + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                done += full * each
            if full < n:
                if left := min(each, total - done):
                    rules.append((length, done, done + left, first + full, each, capacity - room))
                    put(room - left * length, first + full, 1)
                    done += left
                    full += 1
                put(room, first + full, n - full)
    return rules


def pieces_of(tokenizer: str, capacity: int = CAPACITY, end: int = END):
    """mapInArrow function: doc_id, text -> the pieces of each text, numbered by length within the task."""
    last = np.array([end], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer, "word"), TaskContext.get().partitionId(), [0] * (capacity + 1)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
        for group in enc.encode_rows(batches):
            rows = []
            for doc, ids in zip(*group):
                ids += last
                for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[i : i + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc, k, i // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)
        trim()

    return run


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each document.

    Null and empty texts are the end id alone. Only documents of more than `capacity` ids are cut. Rows
    that repeat, with a doc_id or without (null), are documents of their own; pieces of equal length are
    placed in any order. Texts of any length are encoded whole. An empty table gives no rows. Columns other
    than doc_id and text are not read.
    """
    spark: SparkSession = docs.sparkSession
    tune(spark)
    pieces = materialise(need(docs, "doc_id", "text").mapInArrow(pieces_of(tokenizer, capacity, end), PIECES), "pieces")
    # rows: at most one for each length and task
    here = pieces.groupBy("length", "part").agg(F.max("nth").alias("n")).select("length", "part", (F.col("n") + 1).alias("n"))
    counts = {r.length: r.n for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rules = spark.createDataFrame(best_fit_rules(counts, capacity), RULES)
    before = here.selectExpr("length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before")
    placed = pieces.join(before, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("before")).alias("p")
    # the rules' number depends on the capacity alone, not on the corpus
    r = F.broadcast(rules).alias("r")
    found = placed.join(r, (F.col("p.length") == F.col("r.length")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("last")))
    k = F.col("nth") - F.col("first")
    return found.select("doc_id", "piece", "start", F.col("p.length").cast("long").alias("length"), "ids_crc32", (F.col("bin") + F.floor(k / F.col("each"))).alias("sequence_id"), (F.col("at") + F.pmod(k, F.col("each")) * F.col("p.length")).cast("long").alias("offset"))
