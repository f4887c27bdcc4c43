"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

From a bounded sample of labelled rows come the examples' vectors, over all their terms; idf counts every
document of the corpus, and the more a term separates the labels the more it weighs. Alike examples stand in
blocks; for each term and block the index holds the largest weight, whose products with the query bound any
similarity in the block: the most promising blocks are read first, then those that can still hold one of the k
nearest. Postings of a term that many examples hold are stored block by block as rows of weights, those of other
terms as lists. Votes weighted by similarity, with a prior's weight for documents that no example is near, are
calibrated by leaving each example out once. No row is among its own neighbours.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialise, need, release, trim, tune, words_of
from .vectors import kmeans, squared

#: Bound of the fitted model: labelled rows sampled. All their terms are kept.
EXAMPLES = 12_000
NEIGHBOURS, BLOCK = 15, 64
#: Share of the blocks, those of largest bounds, that are read before any is left out.
FIRST = 1 / 8
#: Share of the examples from which on a term's postings are rows of weights.
DENSE = 1 / 16
#: Queries that are searched together.
BATCH = 128
#: More than rounding in single precision can change a similarity; what is that near the least is computed anew.
SLACK = 1e-5
#: Weight of the prior among the votes; a neighbour weighs its squared similarity.
PRIOR_WEIGHT = 0.1
#: How strongly calibration is drawn to leaving the votes as they are: few labels change them little.
RIDGE = 1.0
EDGES = ".,;:!?\"'()[]{}<>«»¿¡…-–—*_/\\|"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of the texts, each word's term, each word's text. Terms are words in lower case without
    punctuation at their ends."""
    words, counts = words_of(texts)
    values = pc.utf8_trim(pc.utf8_lower(words.dictionary.cast(pa.large_string())), EDGES).dictionary_encode()
    index = values.indices.to_numpy()[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    return values.dictionary, index, np.repeat(np.arange(len(counts)), counts)


def counts_of(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term number, times) of the listed terms, which are distinct, in the texts, ascending."""
    values, index, text = terms_of(texts)
    # the hash table is of the texts' few terms, not of the list
    place = pc.index_in(terms, value_set=values.cast(terms.type)).fill_null(-1).to_numpy()
    number = np.full(len(values), -1)
    listed = np.flatnonzero(place >= 0)
    number[place[listed]] = listed
    found = number[index] if len(index) else np.zeros(0, np.int64)
    key = text[found >= 0] * len(terms) + found[found >= 0]
    key, times = np.unique(key, return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), times


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] to start[i] + size[i] - 1, one range after the other."""
    ends = np.cumsum(size, dtype=np.intp)
    out = np.repeat(start - ends + size, size)
    out += np.arange(len(out))
    return out


class BlockMaxIndex:
    """Unit vectors in blocks; vectors: (ascending term numbers, weights > 0) one after the other. A segment is
    what one block holds of one term's list. Each worker makes one, so what is needed only to make it goes as
    soon as it can."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        parts = list(vectors)
        self.make(np.array([len(v[0]) for v in parts]), np.concatenate([v[0] for v in parts]), np.concatenate([v[1] for v in parts]), terms, block)

    @classmethod
    def of(cls, scorer: Scorer) -> BlockMaxIndex:
        """The index of a model's examples."""
        made = cls.__new__(cls)
        held = scorer.examples()
        # make() alone holds the arrays that it lets go
        size, parts = np.diff(held[0], prepend=0), [scorer.flat_weights(held), held[1]]
        del held
        made.make(size, parts.pop(), parts.pop(), len(scorer.terms), BLOCK)
        return made

    def make(self, size: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, block: int) -> None:
        """size: terms of each vector; term, weight: all vectors', one after the other."""
        n, self.width = len(size), block
        often = np.flatnonzero(np.bincount(term, minlength=terms) >= max(2, n * DENSE))
        self.slot = np.full(terms, -1, np.int32)
        self.slot[often] = np.arange(len(often))
        rows = np.zeros((n, len(often)), np.float32)
        slot = self.slot[term]
        rows[np.repeat(np.arange(n, dtype=np.int32), size)[slot >= 0], slot[slot >= 0]] = weight[slot >= 0]
        del slot
        self.order = self.arrange(rows, block)
        self.blocks = -(-n // block)
        self.rows = np.zeros((self.blocks, len(often), block), np.float32)
        for b in range(self.blocks):
            here = self.order[b * block : (b + 1) * block]
            self.rows[b, :, : len(here)] = rows[here].T
        del rows
        self.row_most = self.rows.max(2).T.copy() if len(often) else np.zeros((0, self.blocks), np.float32)
        # the vectors one after the other, in the order of their places
        self.size = size[self.order]
        self.start = np.cumsum(self.size) - self.size
        bounds = [(b - z, b) for b, z in zip(np.cumsum(size)[self.order].tolist(), self.size.tolist())]
        self.term = np.concatenate([term[a:b] for a, b in bounds])
        del term
        self.weight = np.concatenate([weight[a:b] for a, b in bounds])
        del weight, bounds
        self.asked = np.zeros(terms)  # one query's weights by term
        # lists of the other terms
        trim()
        rare = np.flatnonzero(self.slot[self.term] < 0).astype(np.min_scalar_type(-len(self.term) - 1))
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        listed, self.place = self.term[rare], np.repeat(np.arange(n, dtype=np.int32), self.size)[rare]
        self.list_weight, within = self.weight[rare].astype(np.float32), self.place // block
        del rare
        new = np.ones(len(listed), bool)
        new[1:] = (listed[1:] != listed[:-1]) | (within[1:] != within[:-1])
        first = np.flatnonzero(new)
        self.list_start, self.list_size = first.astype(np.int32), np.diff(first, append=len(listed)).astype(np.min_scalar_type(-block - 1))
        self.block = within[first]
        self.most = np.maximum.reduceat(self.list_weight, first) if len(first) else np.zeros(0, np.float32)
        self.segment = np.searchsorted(listed[first], np.arange(terms + 1, dtype=listed.dtype))

    @staticmethod
    def arrange(rows: np.ndarray, block: int) -> np.ndarray:
        """Numbers of the vectors so that alike ones, by the terms that many hold, share blocks."""
        groups = max(1, len(rows) // (4 * block))
        if groups == 1 or not rows.shape[1]:
            return np.arange(len(rows))
        centres = kmeans(rows[:: max(1, len(rows) // (40 * groups))], groups, rounds=4).astype(np.float32)
        near = np.concatenate([squared(rows[i : i + 1024], centres).argmin(1) for i in range(0, len(rows), 1024)])
        return np.argsort(near, kind="stable")

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list | None = None) -> list[list[tuple[float, int]]]:
        """For each query (terms, weights) the k vectors of largest positive cosine but those in its `without`:
        (cosine, number), ties by number; exact."""
        out: list[list[tuple[float, int]]] = []
        without = without or [()] * len(queries)
        for low in range(0, len(queries), BATCH):
            out += self.search(queries[low : low + BATCH], k, without[low : low + BATCH])
        return out

    def search(self, queries: list, k: int, without: list) -> list[list[tuple[float, int]]]:
        n, wide = len(self.order), self.blocks * self.width
        q, lists = np.zeros((len(queries), self.rows.shape[1]), np.float32), []
        bound = np.zeros((len(queries), self.blocks), np.float32)
        for i, (terms, weights) in enumerate(queries):
            # take() with whole-word numbers is much quicker than brackets
            slot = self.slot.take(terms)
            often, rare = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
            q[i, slot.take(often)] = weights.take(often)
            terms, weights = terms.take(rare), weights.take(rare).astype(np.float32)
            first = self.segment.take(terms)
            size = self.segment.take(terms + 1) - first
            segments, weights = ranges(first, size), np.repeat(weights, size)
            lists.append((segments, weights, self.block.take(segments)))
            bound[i] = np.bincount(lists[i][2], self.most.take(segments) * weights, minlength=self.blocks)
        bound += q @ self.row_most + SLACK
        score, least = np.zeros((len(queries), wide), np.float32), np.zeros(len(queries), np.float32)
        read = bound >= -np.partition(-bound, max(0, int(self.blocks * FIRST) - 1), axis=1)[:, max(0, int(self.blocks * FIRST) - 1), None]
        for now in (read, ~read):
            if now is not read:
                least = np.array([self.least(s, k + len(w)) for s, w in zip(score, without)], np.float32)
                now = now & (bound >= least[:, None] - SLACK)
            for b in np.flatnonzero(now.any(0)).tolist():
                who = np.flatnonzero(now[:, b])
                score[who, b * self.width : (b + 1) * self.width] += q[who] @ self.rows[b]
            for i, (segments, weights, block) in enumerate(lists):
                use = np.flatnonzero(now[i].take(block))
                segments, weights = segments.take(use), weights.take(use)
                size = self.list_size.take(segments).astype(np.intp)
                at = ranges(self.list_start.take(segments), size)
                score[i] += np.bincount(self.place.take(at), self.list_weight.take(at) * np.repeat(weights, size), minlength=wide)
        return [self.exact(x, s[:n], k, w) for x, s, w in zip(queries, score, without)]

    @staticmethod
    def least(score: np.ndarray, k: int) -> float:
        """A bound of the k-th largest from below: the k-th largest of the maxima of groups."""
        if len(score) <= k:
            return 0.0
        if len(score) >= 64 * k:
            score = score[: len(score) // 16 * 16].reshape(16, -1).max(0)
        return float(np.partition(score, -k)[-k])

    def exact(self, query: tuple, score: np.ndarray, k: int, without) -> list[tuple[float, int]]:
        """The k nearest among those that single precision puts near or above the k-th."""
        near = np.flatnonzero(score >= max(self.least(score, k + len(without)) - SLACK, 1e-30))
        near = near[~np.isin(self.order[near], without)] if len(without) else near
        if not len(near):
            return []
        near = near[score[near] >= self.least(score[near], k) - SLACK]
        at, size = ranges(self.start[near], self.size[near]), self.size[near]
        self.asked[query[0]] = query[1]
        found = np.add.reduceat(self.asked.take(self.term.take(at)) * self.weight.take(at), np.cumsum(size) - size)
        self.asked[query[0]] = 0
        best = np.lexsort((self.order[near], -found))[:k]
        return [(float(found[i]), int(self.order[near[i]])) for i in best if found[i] > 0]


class Scorer:
    """The fitted model: of bounded size, sent to every worker. held: ends, term numbers and times of the
    examples' terms, one example after the other; workers get them packed, leave them so, and make the index
    themselves."""

    def __init__(self, terms: pa.Array, weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, prior: float, held: tuple):
        self.terms, self.weights, self.ids, self.labels, self.prior, self.held = terms, weights, ids, labels, prior, held
        self.slope, self.offset, self.name = 1.0, 0.0, uuid.uuid4().hex

    def __getstate__(self) -> dict:
        ends, term, times = self.examples()
        times = times.astype(np.min_scalar_type(int(times.max(initial=0))))
        packed = [zlib.compress(x.tobytes(), 1) for x in (np.diff(term, prepend=np.int32(0)), times)]
        return {**vars(self), "held": (ends, *packed, times.dtype.str)}

    def examples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends, term numbers and times, unpacked."""
        if len(self.held) == 3:
            return self.held
        ends, term, times, kind = self.held
        return ends, np.cumsum(np.frombuffer(zlib.decompress(term), np.int32), dtype=np.int32), np.frombuffer(zlib.decompress(times), kind)

    def vector(self, i: int, held: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of example i; held: of examples()."""
        ends, term, times = held
        a, b = ends[i - 1] if i else 0, ends[i]
        return self.unit(term[a:b], times[a:b].astype(np.int32))

    def flat_weights(self, held: tuple) -> np.ndarray:
        """The weights of all examples' unit vectors, one after the other."""
        out = np.empty(len(held[1]))
        for i, end in enumerate(held[0].tolist()):
            w = self.vector(i, held)[1]
            out[end - len(w) : end] = w
        return out

    def unit(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(times)) * self.weights[terms]
        return terms, w / np.linalg.norm(w)

    def index(self) -> BlockMaxIndex:
        return kept(self.name, lambda: BlockMaxIndex.of(self))

    def votes(self, queries: list, without: list) -> list[tuple[float, list]]:
        """(share of label 1 among the neighbours, neighbours) of each query."""
        out, index = [], self.index()
        for near in index.nearest(queries, NEIGHBOURS, without):
            total = sum(s * s for s, _ in near)
            out.append(((sum(s * s * self.labels[i] for s, i in near) + PRIOR_WEIGHT * self.prior) / (total + PRIOR_WEIGHT), near))
        return out

    def same(self, ids: list) -> list[list[int]]:
        """For each doc_id the numbers of the examples that are this row: they have no vote on it."""
        by: dict[int, list[int]] = {}
        for i, doc in enumerate(self.ids.tolist()):
            by.setdefault(doc, []).append(i)
        return [by.get(x, []) for x in ids]

    def calibrated(self, vote: float) -> float:
        x = self.slope * math.log(max(vote, 1e-9) / max(1 - vote, 1e-9)) + self.offset
        return 1 / (1 + math.exp(-min(max(x, -40), 40)))

    def calibrate(self, v: np.ndarray) -> None:
        """Logistic fit of the labels on the log-odds of votes v, each example's without its own row."""
        y = self.labels.astype(float)
        # targets that a finite sample allows, and no examples of one label: the votes stand as they are
        pos, neg = y.sum(), len(y) - y.sum()
        if not pos or not neg:
            return
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        x = np.log(np.clip(v, 1e-9, 1) / np.clip(1 - v, 1e-9, 1))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - t) * x).sum() + RIDGE * (a - 1), (p - t).sum() + RIDGE * b])
            h = np.array([[(w * x * x).sum() + RIDGE, (w * x).sum()], [(w * x).sum(), w.sum() + RIDGE]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        if a > 0:
            self.slope, self.offset = float(a), float(b)


def evidence_of(pos: np.ndarray, neg: np.ndarray, n: int, positive: int) -> np.ndarray:
    """Twice the log-likelihood ratio of the terms' document counts: how far each separates the labels."""
    p, k = positive / n, pos + neg

    def part(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        return x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, e, 1))

    inside = part(pos, k * p) + part(neg, k * (1 - p))
    outside = part(positive - pos, (n - k) * p) + part(n - positive - neg, (n - k) * (1 - p))
    return np.maximum(2 * (inside + outside), 0)


def weight_of(evidence: np.ndarray) -> np.ndarray:
    """Factor of a term's weight. Chance alone gives evidence 1, which all terms have at least."""
    return np.sqrt(1 + evidence)


def fold_of(doc_id: str, folds: int):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, examples: int = EXAMPLES, keep: bool = True) -> Scorer | None:
    """Fits the model on at most `examples` labelled rows outside fold 0, picked by a hash of doc_id. keep:
    workers keep the index between tasks."""
    known = need(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != 0))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(examples)  # doc_id and label alone
    sample = materialise(need(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples), "examples")
    seen = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, positive = sum(seen.values()), seen.get(1, 0)
    if not n:
        return None

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            values, index, text = terms_of(b.column(0))
            key = np.unique(text * max(1, len(values)) + index)
            term, own = key % max(1, len(values)), b.column(1).to_numpy()[key // max(1, len(values))]
            pos, all_ = np.bincount(term, own, minlength=len(values)).astype(np.int64), np.bincount(term, minlength=len(values))
            yield pa.RecordBatch.from_arrays([values.cast(pa.string()), pa.array(pos), pa.array(all_ - pos)], ["term", "pos", "neg"])

    counted = sample.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(distinct, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    table = counted.where("term <> ''").toArrow().sort_by("term")
    evidence = evidence_of(table.column("pos").to_numpy(), table.column("neg").to_numpy(), n, positive)
    vocabulary = table.column("term").cast(pa.large_string()).combine_chunks()
    value_set = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the examples

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, df = 0, np.zeros(len(value_set.value), np.int64)
        for b in batches:
            df += np.bincount(counts_of(b.column(0), value_set.value)[1], minlength=len(df))
            total += b.num_rows
        # the number of texts as one more term
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, len(df)), pa.int64()), pa.array(np.append(df[held], total), pa.int64())], ["term", "df"])

    sums = need(docs, "text").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    weights = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1) * weight_of(evidence)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, term, times = counts_of(b.column(1), value_set.value)
            cut = np.searchsorted(text, np.arange(b.num_rows + 1))
            part = lambda x: pa.array([x[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), part(term), part(times)], ["doc_id", "toxic", "terms", "times"])

    rows = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(vectors, "doc_id long, toxic int, terms binary, times binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic))
    with_terms, without = [r for r in rows if r.terms], [r for r in rows if not r.terms]
    prior = (sum(r.toxic for r in without) + positive / n) / (len(without) + 1)
    flat = lambda x: np.frombuffer(b"".join(x), np.int32)
    held = np.cumsum([len(r.terms) // 4 for r in with_terms]), flat(r.terms for r in with_terms), flat(r.times for r in with_terms)
    scorer = Scorer(vocabulary, weights, np.array([r.doc_id for r in with_terms], np.int64), np.array([r.toxic for r in with_terms], np.int64), prior, held)
    del rows, with_terms
    if len(scorer.ids):
        sent, n = docs.sparkSession.sparkContext.broadcast(scorer), len(scorer.ids)  # bounded by the examples

        def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            model.index()  # before the examples are unpacked beside it
            held = model.examples()
            for b in batches:
                i = b.column(0).to_numpy()
                votes = model.votes([model.vector(x, held) for x in i], model.same(model.ids[i].tolist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v for v, _ in votes], pa.float64())], ["id", "vote"])
            if not keep:
                release()

        voted = docs.sparkSession.range(0, n, 1, min(16, n // 256 + 1)).mapInArrow(left_out, "id long, vote double").toArrow().sort_by("id")
        scorer.calibrate(voted.column("vote").to_numpy())
    return scorer


RESULT = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: bigint, similarity: double, toxic: int>>"
EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))


def score_rows(scorer: Scorer | None, ids: pa.Array, texts: pa.Array) -> tuple[list[float], list[list[tuple]]]:
    """Scores and evidence of texts. Texts without known terms have the prior of such examples."""
    if scorer is None:
        return [0.0] * len(texts), [[]] * len(texts)
    score, why = [scorer.prior] * len(texts), [[] for _ in range(len(texts))]
    if len(scorer.ids):
        text, term, times = counts_of(texts, scorer.terms)
        cut = np.flatnonzero(np.diff(text, prepend=-1))
        queries = [scorer.unit(term[a:b], times[a:b]) for a, b in zip(cut, np.append(cut[1:], len(text)))]
        own = scorer.same(ids.to_pylist())
        for t, (vote, near) in zip(text[cut].tolist(), scorer.votes(queries, [own[t] for t in text[cut].tolist()])):
            score[t] = scorer.calibrated(vote)
            why[t] = [(int(scorer.ids[i]), s, int(scorer.labels[i])) for s, i in near[:3]]
    return score, why


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, model: Scorer | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the nearest three examples): one row per document.

    Labels are learned only from rows whose crc32(doc_id as text) mod `folds` is not 0; the examples with a
    row's own doc_id have no vote on it. Null and empty texts
    and texts without a known term have the share of label 1 among such examples, drawn to that among all by
    the weight of one example; without any labelled row every score is 0. Null labels are not learned from; rows that repeat are scored, and learned from, each
    by itself; a null doc_id counts as empty text for the fold and is never learned from; texts of any length
    are read whole; equal similarities rank by example; an empty table gives no rows. Only doc_id, text and
    toxic are read.
    """
    tune(docs.sparkSession)
    scorer = model or fit(docs, labels, folds)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by EXAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, why = score_rows(sent.value, b.column(0), b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array([[dict(zip(("doc_id", "similarity", "toxic"), x)) for x in w] for w in why], EVIDENCE)], ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = need(docs, "doc_id", "text").select("doc_id", "text", (fold_of("doc_id", folds) == 0).alias("held_out"))
    return rows.mapInArrow(run, RESULT)


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, model: Scorer | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic; as score_toxicity() otherwise.
    Other steps of a pipeline leave more workers than run at once: each lets its index go after a task."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, folds, keep=False))
    at, doc = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([s < 0.5 for s in score_rows(sent.value, b.column(doc), b.column(at))[0]], pa.bool_()))
        release()
        trim()

    return docs.mapInArrow(run, docs.schema)
