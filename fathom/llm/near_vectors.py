"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves, each half with a codebook of its own; the product of the codebooks is a
grid of cells. A vector visits cells in the order of a multi-sequence traversal: by the sum of the squared
distances from its halves to the two codewords' regions, smallest first, until the cells left can hold less
than 1 - target of the vectors at the least cosine (with the difference spread evenly over all directions).
What stands in the visited cells is verified in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, need, tune
from .vectors import fine, kmeans, matrix, sample_of, squared, unit, usable

LEAST = 0.95
TARGET = 0.999
#: Rows that the codebooks are fitted on, vectors of a cell on average, and codewords of a half at most.
SAMPLE, CELL, MOST_WORDS = 8192, 200, 256
#: Vectors of a cell that one task holds; a fuller cell is cut.
CHUNK = 1024


class MultiIndex:
    def __init__(self, sample: np.ndarray, words: int):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, : self.half], words), kmeans(sample[:, self.half :], words, seed=2)]
        self.gaps = [np.sqrt(squared(b, b)) for b in self.books]

    def regions(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half: the nearest codeword of each vector, and squared distances to all words' regions."""
        near, far = [], []
        for part, book, gap in zip((x[:, : self.half], x[:, self.half :]), self.books, self.gaps):
            d = squared(part, book)
            a = d.argmin(1)
            reach = (d - d[np.arange(len(d)), a][:, None]) / np.maximum(2 * gap[a], 1e-12)
            reach[np.arange(len(d)), a] = 0
            near.append(a)
            far.append(np.maximum(reach, 0) ** 2)
        return near, far

    def cells(self, x: np.ndarray) -> np.ndarray:
        (a, b), _ = self.regions(x)
        return a.astype(np.int64) * len(self.books[1]) + b

    def traverse(self, one: np.ndarray, two: np.ndarray, limit: float) -> Iterator[tuple[float, int]]:
        """Multi-sequence: cells by ascending sum of one[i] + two[j], up to limit."""
        p, q = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        heap, seen = [(one[p[0]] + two[q[0]], 0, 0)], {(0, 0)}
        while heap:
            d, i, j = heapq.heappop(heap)
            if d > limit:
                return
            yield d, int(p[i]) * len(two) + int(q[j])
            for nxt in ((i + 1, j), (i, j + 1)):
                if nxt[0] < len(p) and nxt[1] < len(q) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (one[p[nxt[0]]] + two[q[nxt[1]]], *nxt))


def visit_limit(least: float, target: float, width: int) -> float:
    """Squared distance at which the traversal ends: a difference of squared length 2 - 2 * least has in any
    one direction a deviation of its share of it."""
    return NormalDist().inv_cdf(1 - (1 - target) / 2) ** 2 * (2 - 2 * least) / width


def deal(index: MultiIndex, width: int, limit: float):
    """(rid, times, vec) -> the vector in its own cell (side 0) and as a visitor of cells after it (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(matrix(b.column(2).to_pylist(), width))
            (p, q), (one, two) = index.regions(x)
            home = p.astype(np.int64) * len(index.books[1]) + q
            row, cell, side = [], [], []
            for i in range(len(x)):
                row.append(i), cell.append(int(home[i])), side.append(0)
                # a pair of two cells is found by the visitor from the first of them, so once
                for _, c in index.traverse(one[i], two[i], limit):
                    if c > home[i]:
                        row.append(i), cell.append(c), side.append(1)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(side, pa.int32()), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take)], ["cell", "side", "rid", "times", "vec"])

    return run


OUT = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("src", pa.int64()), ("dst", pa.int64())])


def verify(width: int, least: float):
    """Rows sorted by (cell, chunk, side): counts of links, and edges of a forest over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, visitors = None, [], []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def against(rows, same: bool):
            m, v = unit(matrix([r[3] for r in members], width)), unit(matrix([r[3] for r in rows], width))
            hit = v @ m.T >= least
            if same:
                # visitors of the same cell from its other chunks are compared once: from the lower chunk
                hit &= np.array([[r[1] != s[1] for s in members] for r in rows]) if rows is members else True
            mt, vt = np.array([r[2] for r in members], np.int64), np.array([r[2] for r in rows], np.int64)
            counts, edges = [], []
            for r, n in zip(rows, hit @ mt):
                if n:
                    counts.append((r[1], int(n)))
            if rows is not members:
                for r, n in zip(members, vt @ hit):
                    if n:
                        counts.append((r[1], int(n)))
            for i, j in zip(*np.nonzero(hit)):
                a, b = find(rows[i][1]), find(members[j][1])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((rows[i][1], members[j][1]))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*[(r, n, None, None) for r, n in counts], *[(None, None, s, d) for s, d in edges])] if counts else [pa.array([], pa.int64())] * 4, schema=OUT)

        def flush():
            if members and visitors:
                yield against(visitors, False)
            visitors.clear()

        for b in batches:
            for cell, chunk, side, rid, times, vec in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if (cell, chunk) != key:
                    yield from flush()
                    if len(members) > 1 and key is not None:
                        yield against(members, True)
                    key, members = (cell, chunk), []
                    root.clear()
                if side == 0:
                    members.append((side, rid, times, vec))
                else:
                    visitors.append((side, rid, times, vec))
                    if len(visitors) >= CHUNK:
                        yield from flush()
        yield from flush()
        if len(members) > 1:
            yield against(members, True)

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector.

    Links are pairs found with cosine >= `least`, computed in double precision. Equal vectors are one vector
    with a multiplicity. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. The index is fitted on at most `sample` rows and holds every row. component_id is the smallest
    vec_id that links reach, kept whether it is the row's own. Rows that repeat a vec_id are vectors of their
    own; a null vec_id is never the smallest and never kept; an empty table gives no rows. Only vec_id and embedding are read.
    """
    tune(vectors.sparkSession)
    good = usable(vectors)
    # the same vector, whatever row it is in; 128 bits
    keyed = good.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.reverse("vec"), F.lit(7)))
    classes = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.any_value("vec").alias("vec"))
    classes = materialise(classes.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    n, width = size.n, max(2, size.width or 0)
    bad = need(vectors, "vec_id", "embedding").where(~fine("embedding"))
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not n:
        return alone
    words = min(MOST_WORDS, max(2, math.ceil(math.sqrt(n / CELL))))
    index = MultiIndex(unit(sample_of(classes, sample, width, "k1")), words)
    limit = visit_limit(least, target, width)

    dealt = classes.select("rid", "times", "vec").mapInArrow(deal(index, width, limit), "cell long, side int, rid long, times long, vec array<double>")
    dealt = materialise(dealt, "cells")
    # the grid is bounded, so are its counts
    fill = dealt.where("side = 0").groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = dealt.join(F.broadcast(fill), "cell")  # visitors of empty cells go
    own = F.pmod(F.xxhash64("rid"), F.col("chunks").cast("long")).cast("int")
    members = placed.where("side = 0").withColumn("chunk", own)
    # a cell of several chunks: its members visit the chunks after their own
    inner = members.where("chunks > 1").withColumn("chunk", F.explode(F.when(F.col("chunk") + 1 < F.col("chunks"), F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)))).withColumn("side", F.lit(1))
    guests = placed.where("side = 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cols = ["cell", "chunk", "side", "rid", "times", "vec"]
    every = members.select(cols).unionByName(inner.select(cols)).unionByName(guests.select(cols))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = every.repartition(max(parts, n // 4000), "cell", "chunk").sortWithinPartitions("cell", "chunk", "side").mapInArrow(verify(width, least), "rid long, n long, src long, dst long")
    found = materialise(found, "found")
    links = found.where("rid IS NOT NULL").groupBy("rid").agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("src IS NOT NULL").select("src", "dst"))
    lowest = comp.join(classes.select(F.col("rid").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("low"))
    named = comp.join(lowest, "component").select(F.col("id").alias("rid"), "low")
    done = classes.join(links, "rid", "left").join(named, "rid", "left").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), F.coalesce("low", "least").alias("component_id"))
    rows = keyed.select("vec_id", "k1", "k2").join(done, ["k1", "k2"]).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return rows.unionByName(alone)
