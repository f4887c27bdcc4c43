"""Approximate nearest neighbours by additive quantisation, with exact reranking.

A vector's direction is coded as a sum of full-dimensional codewords, one from each codebook, found by beam
search over what the earlier codewords leave. The code, the vector's norm and the vector are stored. A query
makes one table of its products with all codewords; a code's score is the sum of its entries times the norm.
The best scored of a block are reranked there by exact products with the vectors, and the blocks' best merged.
How many: as many as brute force over the sample shows to be needed for the target recall, for these vectors.
Equal vectors are indexed once, with as many of their smallest ids as an answer can hold, and expanded after
ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tune
from .vectors import kmeans, lengths, matrix, sample_of, squared, unit, usable

BOOKS, WORDS, BEAM = 16, 256, 4
#: Rows that the codebooks are fitted on.
SAMPLE = 8192
#: Vectors of a block, queries of a block, and the least share of a block's codes that is reranked (64 at least).
BLOCK, QUERIES, RERANK = 8192, 1024, 1 / 24
#: Recall that the reranked share must reach on the sample, by this many of its vectors as queries; and by how
#: much it is then enlarged.
TARGET, PROBES, MARGIN = 0.98, 128, 1.25


class AdditiveQuantiser:
    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM):
        self.beam, self.books = beam, []
        rest = sample.copy()
        for m in range(books):
            book = kmeans(rest, words, rounds=5, seed=m + 1)
            self.books.append(book)
            rest = rest - book[squared(rest, book).argmin(1)]
        self.books = [b.astype(np.float32) for b in self.books]
        # least squares for all codewords together, with the sample's codes as they are; a few rows at a time,
        # so that the driver holds one square matrix and little else
        codes = self.encode(sample)[0]
        offsets = np.cumsum([0, *map(len, self.books)])
        prior = np.concatenate(self.books).astype(np.float64)
        gram, right = np.eye(len(prior)) * 1e-2, np.zeros_like(prior)
        for low in range(0, len(sample), 512):
            part = codes[low : low + 512]
            a = np.zeros((len(part), len(prior)))
            for m in range(books):
                a[np.arange(len(part)), offsets[m] + part[:, m]] = 1
            gram += a.T @ a
            right += a.T @ (sample[low : low + 512] - a @ prior)
        fitted = prior + np.linalg.solve(gram, right)
        self.books = [fitted[x:y].astype(np.float32) for x, y in zip(offsets[:-1], offsets[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and squared norms of what they stand for."""
        if len(x) > 512:
            parts = [self.encode(x[i : i + 512]) for i in range(0, len(x), 512)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        x = x.astype(np.float32)
        n = len(x)
        codes = np.zeros((n, 1, len(self.books)), np.uint8)
        rest = x[:, None, :]
        for m, book in enumerate(self.books):
            width = rest.shape[1]
            size = (book * book).sum(1)
            cost = (rest * rest).sum(2)[:, :, None] - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, width, -1) + size
            flat = cost.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            from_beam, word = best // len(book), best % len(book)
            codes = np.take_along_axis(codes, from_beam[:, :, None], 1)
            codes[:, :, m] = word
            rest = np.take_along_axis(rest, from_beam[:, :, None], 1) - book[word]
        best = (rest * rest).sum(2).argmin(1)
        codes = codes[np.arange(n), best]
        coded = x - rest[np.arange(n), best]
        return codes, (coded * coded).sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """products[q, m, w] of each query with each codeword."""
        return np.stack([queries.astype(np.float32) @ b.T for b in self.books], 1)


def rerank_share(model: AdditiveQuantiser, sample: np.ndarray, top: int) -> float:
    """Share of the sample's codes, by score, that holds TARGET of the `top` nearest of its own vectors."""
    if len(sample) <= top + 1:
        return 1.0
    codes, norms = model.encode(unit(sample))[0].T.astype(np.intp), lengths(sample)
    probes, ranks = np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int), []
    for i, lut in zip(probes, model.tables(unit(sample[probes]))):
        score = sum(lut[m][codes[m]] for m in range(len(lut))) * norms
        exact = sample @ sample[i]
        exact[i] = -np.inf
        rank = np.empty(len(sample), np.int64)
        rank[np.argsort(-score, kind="stable")] = np.arange(len(sample))
        ranks.append(rank[np.argpartition(-exact, top - 1)[:top]])
    return min(1.0, max(RERANK, MARGIN * (float(np.quantile(np.concatenate(ranks), TARGET)) + 1) / len(sample)))


def encode_rows(model: AdditiveQuantiser, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(3).to_pylist(), width)
                codes, norms = model.encode(unit(x))[0], lengths(x)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], ["k1", "k2", "ids", "vec", "code", "norm"])

    return run


def search_block(model: AdditiveQuantiser, width: int, top: int, share: float):
    """cogroup function: one block of vectors, one block of queries."""
    schema = pa.schema([("query_rid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = matrix(data.column("vec").to_pylist(), width), matrix(queries.column("q_vec").to_pylist(), width)
        codes = np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint8).reshape(len(x), -1).T.astype(np.intp)
        ids, at = data.column("ids").to_pylist(), {k: i for i, k in enumerate(zip(data.column("k1").to_pylist(), data.column("k2").to_pylist()))}
        least = np.array([i[0] for i in ids])
        norms = data.column("norm").to_numpy()
        most = min(len(x), max(64, top + 1, int(len(x) * share)))
        out: list[list] = [[], [], [], []]
        for lut, v, rid, qid, *key in zip(model.tables(unit(q)), q, *[queries.column(c).to_pylist() for c in ("q_rid", "q_id", "q_k1", "q_k2")]):
            score = lut[0][codes[0]]
            for m in range(1, len(lut)):
                score += lut[m][codes[m]]
            score = score * norms
            near = np.argpartition(-score, most - 1)[:most] if most < len(x) else np.arange(len(x))
            exact = x[near] @ v
            best = np.lexsort((least[near], -exact))[: top + 1]  # the query's own may hold no other row
            own, found = at.get(tuple(key), -1), []
            for c, p in zip(near[best].tolist(), exact[best].tolist()):
                others = ids[c]
                if c == own:  # every row but the query's own
                    others = [*others]
                    if qid in others:
                        others.remove(qid)
                found += [(-p, i) for i in others[:top]]
            found = sorted(found)[:top]
            out[0] += [rid] * len(found)
            out[1] += [qid] * len(found)
            out[2] += [i for _, i in found]
            out[3] += [-p for p, _ in found]
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def build_index(vectors: DataFrame, sample: int = SAMPLE, top: int = 20) -> tuple[DataFrame, DataFrame, AdditiveQuantiser | None, int, float]:
    """The usable rows (rid, vec_id, vec, k1, k2), the written index (k1, k2, ids, vec, code, norm) of their
    distinct vectors with the `top` + 1 smallest vec_ids of each, the quantiser, the width and the share to rerank."""
    tune(vectors.sparkSession)
    good = materialise(usable(vectors).where(F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "vec"), "vectors")
    width = good.agg(F.max(F.size("vec")).alias("w")).first().w
    if not width:
        return good, good, None, 0, 1.0
    # the same vector, whatever row it is in; 128 bits
    good = good.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vec")))).withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.reverse("vec"), F.lit(7)))
    # Spark keeps to the limit before it shuffles, so large groups stay small
    first = good.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("nth") <= top + 1)
    classes = materialise(first.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.any_value("vec").alias("vec")), "classes")
    rows = sample_of(classes, sample, width, "k1")
    model = AdditiveQuantiser(unit(rows))
    index = materialise(classes.mapInArrow(encode_rows(model, width), "k1 long, k2 long, ids array<long>, vec array<double>, code binary, norm double"), "codes")
    return good, index, model, width, rerank_share(model, rows, top)


def search(vectors: DataFrame, every: int = 20, top: int = 20, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by `every` the `top` other rows of
    largest inner product found, best first, ties by smaller vec_id; all of them if there are fewer.

    Scores are exact products in double precision; which rows are found is approximate (`share` of each
    block's codes is reranked, by default what rerank_share() finds). Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without a vec_id, take no part; shorter vectors count as if zeros followed; rows that repeat are rows
    of their own; an empty table gives no rows. Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    good, index, model, width, needed = build_index(vectors, top=top)
    share = needed if share is None else share
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = good.where(F.col("vec_id") % every == 0).select(F.col("rid").alias("q_rid"), F.col("vec_id").alias("q_id"), F.col("vec").alias("q_vec"), F.col("k1").alias("q_k1"), F.col("k2").alias("q_k2"))
    n, m = index.count(), asked.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    number = lambda x, k: F.pmod(F.xxhash64(x), F.lit(k)).cast("int")
    data = index.withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.lit(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = asked.withColumn("q_group", number("q_rid", groups)).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = data.groupBy("block", "group").cogroup(queries.groupBy("q_block", "q_group")).applyInArrow(search_block(model, width, top, share), "query_rid long, query_id long, vec_id long, score double")
    ranked = near.selectExpr("query_id", "CAST(row_number() OVER (PARTITION BY query_rid ORDER BY score DESC, vec_id) AS int) AS rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= top)
