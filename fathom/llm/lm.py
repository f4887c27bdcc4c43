"""Language-model scores from a weighted backoff automaton over the whole corpus' n-grams.

The automaton: each n-gram that training texts hold is a state; reading token v in state s follows the arc
s -> sv if that n-gram is known, else the failure arc to the state of s without its first token, with the
failure arc's weight. Arc and failure weights come from Dirichlet smoothing of each order by the next lower:

    p(v | s) = (c(s v) + m p(v | shorter s)) / (c(s) + m),   p(v) = (c(v) + 1) / (N + V + 1)

so the failure weight of s is log10(m / (c(s) + m)), and all words together, known or not, have mass 1.
No task holds the whole automaton: texts are put into blocks; a block asks for the counts of just the n-grams
that its texts meet (sorted, packed hashes, dealt by hash range, counted once over all blocks, and sent back),
makes from them the part of the automaton that its texts can reach, states, arcs and failure arcs, and reads
each text once from left to right, carrying the state and adding up the weights of the arcs it follows.
N-grams are told apart by hashes of 63 bits.

Counts are asked for in two rounds. The first also tells which n-grams other blocks hold too. An n-gram of the
longest order whose first or last tokens form one that this block holds alone is in this block alone as well: the
block knows its count, and does not ask in the second round.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_bytes, bucket_edges, mix, need, pack, parts_for, trim, tune, unpack, word_hashes, words_of

ORDER = 3
#: Weight, in counts, of the lower order's distribution at each order from the second on.
PRIOR = 8.0
#: Bytes of the texts of a block, at least; a longer text has a block of its own.
BLOCK_BYTES = 9 << 20
#: Lowest bit of a hash: given up for a mark.
MARK = np.uint64(1)

START, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
STEP = np.uint64(0x9E3779B97F4A7C15)


class BackoffAutomaton:
    """States, arcs and failure arcs that the texts of a block can reach.

    grams[k]: for each event (a token to read) the number of the n-gram of k + 1 tokens that ends there, -1 for
    none; counts[k]: how often training texts hold each of these n-grams; starts: training texts; tokens,
    types: N and V. State 0 has read nothing that it remembers, state 1 the start of a text; then come the
    known n-grams of fewer tokens than `order`.
    """

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray], first: np.ndarray, starts: int, tokens: int, types: int, prior: float):
        order = len(grams)
        self.order, self.known = order, counts[0][grams[0]] > 0
        state_of, size, fail_to = [], 2, [np.array([0, 0])]  # state_of[k]: of each n-gram of k + 1 tokens
        held = [np.array([0, starts])]  # training counts of the states
        for k in range(order - 1):
            fine = counts[k] > 0
            states = np.where(fine, size + np.cumsum(fine) - 1, -1)
            state_of.append(states)
            size += int(fine.sum())
            held.append(counts[k][fine])
            if not k:
                fail_to.append(np.zeros(int(fine.sum()), np.int64))
                continue
            # without its first token: the n-gram of one token fewer that ends at the same event
            shorter = np.zeros(len(fine), np.int64)
            here = np.flatnonzero(grams[k] >= 0)
            shorter[grams[k][here]] = state_of[k - 1][grams[k - 1][here]]
            fail_to.append(shorter[fine])
        fail_to, held = np.concatenate(fail_to), np.concatenate(held)
        loss = np.log10(prior / (held + prior))
        loss[0] = 0.0
        # arcs[k] by n-gram of k + 1 tokens: where it leads, -1 if there is none, and its weight. The arc of an
        # unknown word leads from state 0 to itself
        self.to, self.weight, lower = [], [], None
        for k in range(order):
            n, here = len(counts[k]), np.flatnonzero(grams[k] >= 0)
            if not k:
                weight = np.log10((counts[0] + 1) / (tokens + types + 1))
                to = np.maximum(state_of[0], 0) if order > 1 else np.zeros(n, np.int64)
            else:
                source, shorter = np.zeros(n, np.int64), np.zeros(n, np.int64)
                before = state_of[k - 1][grams[k - 1][here - 1]]  # without its last token; -1: not known
                if k == 1:
                    begins = np.zeros(len(grams[k]), bool)
                    begins[first] = True
                    before = np.where(begins[here], 1, before)
                source[grams[k][here]], shorter[grams[k][here]] = np.maximum(before, 0), grams[k - 1][here]
                weight = np.log10((counts[k] + prior * 10 ** lower[shorter]) / (held[source] + prior))
                if k < order - 1:
                    to = state_of[k]
                else:  # of as many tokens as a state may have
                    to = np.where(counts[k] > 0, state_of[k - 1][shorter], -1)
                # an n-gram that is not known is read over the failure arc
                weight = np.where(counts[k] > 0, weight, lower[shorter] + loss[source])
            lower = weight
            at = np.where(grams[k] >= 0, to[grams[k]], -1)
            self.to.append(array("q", at.astype(np.int64).tobytes()))
            self.weight.append(array("d", np.where(at >= 0, weight[grams[k]], 0.0).tobytes()))
        self.fail_to, self.loss = array("q", fail_to.astype(np.int64).tobytes()), array("d", loss.tobytes())

    def score(self, low: int, high: int) -> float:
        """Log-probability of the text whose events are low to high - 1."""
        to, weight, fail_to, loss, most = self.to, self.weight, self.fail_to, self.loss, self.order - 1
        total, state, held = 0.0, min(1, most), min(1, most)  # held: tokens that the state remembers
        for i in range(low, high):
            then = to[held][i]
            while then < 0:
                total += loss[state]
                state = fail_to[state]
                held -= 1
                then = to[held][i]
            total += weight[held][i]
            state = then
            if not then:
                held = 0
            elif held < most:
                held += 1
        return total


class Events:
    """All token events of a block: hashes of the n-grams that end at each, by order."""

    def __init__(self, table: pa.Table, order: int):
        row = {c: table.column(c)[0] for c in ("docs", "train", "ends", "texts")}
        self.ids, self.train = row["docs"].values, row["train"].values.to_numpy(zero_copy_only=False)
        data = pa.py_buffer(zstandard.decompress(row["texts"].as_py()))
        words, self.words = words_of(pa.LargeStringArray.from_buffers(len(self.ids), pa.py_buffer(row["ends"].as_py()), data))
        ends = np.cumsum(self.words + 2)
        seq = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        inside = np.ones(len(seq), bool)
        seq[ends - 1], seq[ends - self.words - 2] = END, START
        inside[ends - 1] = inside[ends - self.words - 2] = False
        seq[inside] = word_hashes(words)
        first = np.zeros(len(seq), bool)
        first[ends - self.words - 2] = True
        self.at = np.flatnonzero(~first)  # events
        self.doc = np.repeat(np.arange(len(self.words)), self.words + 1)
        place = self.at - (ends - self.words - 2)[self.doc]
        self.grams, self.valid = [seq[self.at]], [np.ones(len(self.at), bool)]
        last = seq
        for k in range(2, order + 1):
            here = np.zeros(len(seq), np.uint64)
            here[1:] = mix(last[:-1] * STEP + seq[1:] + np.uint64(k)) if len(seq) else 0
            last = here
            self.grams.append(here[self.at])
            self.valid.append(place >= k - 1)
        self.first_event = np.cumsum(self.words + 1) - (self.words + 1)

    def number(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n-grams of k + 1 tokens: the distinct ones, ascending; for each event the number of its own, -1
        for none; how often the block's training texts hold each."""
        valid = self.valid[k]
        own, inverse = np.unique(self.grams[k][valid] & ~MARK, return_inverse=True)
        numbers = np.full(len(self.at), -1, np.int64)
        numbers[valid] = inverse
        return own, numbers, np.bincount(inverse, self.train[self.doc][valid], minlength=len(own)).astype(np.int64)

    def unsure(self, k: int, numbers: np.ndarray, n: int, shorter: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """Which of the n n-grams of k + 1 tokens other blocks may hold: both of those of k tokens in them,
        numbered by `shorter`, are there elsewhere."""
        out, here = np.zeros(n, bool), np.flatnonzero(numbers >= 0)
        out[numbers[here]] = elsewhere[shorter[here - 1]] & elsewhere[shorter[here]]
        return out


BUNDLE = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("ends", pa.binary()), ("texts", pa.binary())])


def bundles(size: int):
    """mapInArrow function: doc_id, text, train -> blocks of texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, docs, train, texts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            ends = np.cumsum([0, *map(len, texts)]).astype("<i8").tobytes()
            data = zstandard.compress(b"".join(texts), 1)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part << 20 | seq, docs, train, ends, data), BUNDLE)], schema=BUNDLE)

        for b in batches:
            raw = b.column(1).cast(pa.binary()).to_pylist()
            for doc, text, t in zip(b.column(0).to_pylist(), raw, b.column(2).to_pylist()):
                if held and held + len(text or b"") > size:
                    yield flush()
                    docs, train, texts, held, seq = [], [], [], 0, seq + 1
                docs.append(doc), train.append(t), texts.append(text or b"")
                held += len(text or b"")
        if docs:
            yield flush()

    return run


def rounds(order: int) -> tuple[range, range]:
    """What is asked for first and then: orders, from 0."""
    return (range(order - 1), range(order - 1, order)) if order > 2 else (range(order), range(0))


def wanted(ks: range) -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(f"{x}{k + 1}", pa.binary()) for k in ks for x in "hc"], ("starts", pa.int64())])


def by_bucket(g: np.ndarray, n: np.ndarray, buckets: int) -> tuple[list[bytes], list[bytes]]:
    """Ascending n-grams and their counts, packed, by hash range."""
    cut = np.append(np.searchsorted(g, bucket_edges(buckets)), len(g))
    g = g >> MARK
    return [pack(g[a:b]) for a, b in zip(cut, cut[1:])], [small(n[a:b]) for a, b in zip(cut, cut[1:])]


def ask_counts(order: int, buckets: int):
    """First round: a block's n-grams, sorted, with how often its training texts hold each, by hash range."""
    ks = rounds(order)[0]

    def run(table: pa.Table) -> pa.Table:
        e = Events(table, ks.stop)
        cols: dict[str, list] = {"block": [table.column("block")[0].as_py()] * buckets, "bucket": list(range(buckets)), "starts": [int(e.train.sum())] + [0] * (buckets - 1)}
        trained = e.train[e.doc]
        for k in ks:
            # the mark says whether the event is for training
            g = np.sort((e.grams[k][e.valid[k]] & ~MARK) | trained[e.valid[k]].astype(np.uint64))
            t = (g & MARK).astype(np.int64)
            g &= ~MARK
            first = np.flatnonzero(np.diff(g, prepend=~g[:1])) if len(g) else np.zeros(0, np.int64)
            n = np.add.reduceat(t, first) if len(g) else t
            cols[f"h{k + 1}"], cols[f"c{k + 1}"] = by_bucket(g[first], n, buckets)
        del e, trained, g, t, n
        trim()
        return pa.table([pa.array(cols[f.name], f.type) for f in wanted(ks)], schema=wanted(ks))

    return run


def ask_more(order: int, buckets: int):
    """Second round: of the longest n-grams those that other blocks may hold."""
    k, schema = order - 1, wanted(rounds(order)[1])

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        e = Events(table, order)
        own, shorter, _ = e.number(k - 1)
        elsewhere = answers(counts, k - 1, own, buckets)[1]
        own, numbers, local = e.number(k)
        ask = e.unsure(k, numbers, len(own), shorter, elsewhere)
        h, c = by_bucket(own[ask], local[ask], buckets)
        del e, own, numbers, local, shorter, elsewhere
        trim()
        return pa.table({"block": [table.column("block")[0].as_py()] * buckets, "bucket": pa.array(range(buckets), pa.int32()), f"h{order}": pa.array(h, pa.binary()), f"c{order}": pa.array(c, pa.binary()), "starts": [0] * buckets}, schema=schema)

    return run


def answers(counts: pa.Table, k: int, own: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-grams (ascending) that this block asked for the counts over all blocks, and whether another
    block asked too."""
    rows = counts.filter(pa.compute.is_valid(counts.column(f"c{k + 1}"))).sort_by("bucket")
    cut = np.append(np.searchsorted(own, bucket_edges(buckets)), len(own))
    x = np.concatenate([unsmall(x, m) for x, m in zip(rows.column(f"c{k + 1}").to_pylist(), np.diff(cut).tolist())])
    return x >> 1, (x & 1).astype(bool)


def small(n: np.ndarray) -> bytes:
    """Counts as bytes; 255 says that the count follows among the large ones at the end."""
    if not len(n):
        return b""
    large = n[n >= 255].astype("<u8")
    return zlib.compress(np.minimum(n, 255).astype(np.uint8).tobytes() + large.tobytes(), 1)


def unsmall(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    data = zlib.decompress(data)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", -1, n).astype(np.int64) if len(data) > n else 255
    return out


def answered(order: int) -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(f"c{k}", pa.binary()) for k in range(1, order + 1)], ("distinct", pa.int64()), ("tokens", pa.int64()), ("starts", pa.int64())])


def add_counts(order: int, ks: range):
    """Adds a bucket's counts over all blocks and answers every block in the order in which it asked; counts of
    other orders are null."""

    def run(table: pa.Table) -> pa.Table:
        asked = table.column("block").to_pylist()
        cols: dict[str, list] = {"block": asked, "bucket": table.column("bucket").to_pylist(), **{x: [0] * len(asked) for x in ("distinct", "tokens")}}
        for k in ks:
            h = [unpack(x) for x in table.column(f"h{k + 1}").to_pylist()]
            c = [unsmall(x, len(y)) for x, y in zip(table.column(f"c{k + 1}").to_pylist(), h)]
            ends = np.cumsum([0, *map(len, h)])
            g = np.concatenate(h)
            by = np.argsort(g, kind="stable")
            s = g[by]
            new = np.diff(s, prepend=~s[:1]) != 0 if len(s) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            total = np.add.reduceat(np.concatenate(c)[by], first) if len(s) else np.zeros(0, np.int64)
            back = np.empty(len(g), np.int64)
            back[by] = (2 * total + (np.diff(np.append(first, len(s))) > 1))[np.cumsum(new) - 1] if len(s) else 0
            cols[f"c{k + 1}"] = [small(back[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            if not k:
                cols["distinct"], cols["tokens"] = [int((total > 0).sum())] * len(asked), [int(total.sum())] * len(asked)
        cols["starts"] = [sum(table.column("starts").to_pylist())] * len(asked)
        return pa.table([pa.array(cols.get(f.name, [None] * len(asked)), f.type) for f in answered(order)], schema=answered(order))

    return run


def run_automaton(order: int, prior: float, buckets: int):
    """Makes a block's automaton from the counts and reads the block's texts with it."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        e = Events(table, order)
        v, n, starts = (int(sum(counts.column(x).to_pylist())) for x in ("distinct", "tokens", "starts"))
        grams, held = [], []
        for k in range(order):
            own, numbers, local = e.number(k)
            if k in rounds(order)[0]:
                count, elsewhere = answers(counts, k, own, buckets)
                held.append(count)
            else:
                ask = e.unsure(k, numbers, len(own), grams[k - 1], elsewhere)
                local[ask] = answers(counts, k, own[ask], buckets)[0]
                held.append(local)
            grams.append(numbers)
        e.grams = e.valid = None
        at = e.first_event
        automaton = BackoffAutomaton(grams, held, at, starts, n, v, prior)
        base, known = np.log10((held[0][grams[0]] + 1) / (n + v + 1)), automaton.known.astype(np.int64)
        del grams, held
        trim()
        score = [automaton.score(a, b) for a, b in zip(at.tolist(), (at + e.words + 1).tolist())]
        return pa.table({
            "doc_id": e.ids, "held_out": pa.array(~e.train), "n_tokens": pa.array(e.words + 1), "n_known": pa.array(np.add.reduceat(known, at)),
            "train_tokens": pa.array(np.full(len(at), n)), "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(score, pa.float64()),
        }, schema=schema)

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document.

    Rows whose crc32(doc_id as text) mod `folds` is `fold` are held out; all others are learned from, all of
    them and whole. base_score is the add-one unigram score, score the automaton's log10 probability, both
    with the end token. Null and empty texts are the end alone; a null doc_id counts as empty text for the
    fold (in training, by the default fold); rows that repeat are texts of their own; an empty table gives no
    rows; without training texts every word has the probability of an unknown one. Columns other than doc_id
    and text are not read.
    """
    tune(docs.sparkSession)
    buckets = parts_for(docs, block_bytes(docs, 5 << 20))
    fold_of = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    texts = need(docs, "doc_id", "text").select("doc_id", "text", (fold_of != fold).alias("train"))
    rows = texts.mapInArrow(bundles(block_bytes(docs, BLOCK_BYTES)), "block long, docs array<long>, train array<boolean>, ends binary, texts binary").repartition(buckets, "block")
    once, more = rounds(order)
    wants = rows.groupBy("block").applyInArrow(ask_counts(order, buckets), ddl(wanted(once)))
    counts = wants.groupBy("bucket").applyInArrow(add_counts(order, once), ddl(answered(order)))
    if more:
        wants = rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(ask_more(order, buckets), ddl(wanted(more)))
        counts = counts.unionByName(wants.groupBy("bucket").applyInArrow(add_counts(order, more), ddl(answered(order))))
    return rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run_automaton(order, prior, buckets), RESULT)


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)
