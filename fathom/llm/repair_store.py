"""Token-id files with Re-Pair grammars: binary shards that decode any document, or any ids of it, on its own.

A shard is one row of a Parquet table (so it can live in any store that Spark reads) whose payload is
self-contained, little-endian:

    8 bytes   magic "FTHMRP02"
    6 x u32   documents, rules, symbols of the compressed sequence, first nonterminal, passes, long expansions
    passes    rules made up to each pass, u32 each
    documents symbols u32 each (of the compressed sequence), ids u32 each (expanded)
    lengths   what each rule expands to, in ids: a byte each; 255 says that it is among the long ones, u32 each
    rules     all left symbols, then all right symbols, in as few bits each as the largest symbol needs
    sequence  the symbols, in as many bits each

Grammar rules never cross documents, so a document's symbols expand to just its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hoard, materialise, need, parts_for, trim, tune
from .tokens import encoder

MAGIC = b"FTHMRP02"
HEAD = struct.Struct("<8s6I")
END = 2
#: Ids of a shard, about; a longer document has a shard of its own.
SHARD_IDS = 1 << 18
#: Re-Pair closes its sequence up after a pass while one place in so many may begin a pair that occurs twice.
LINK_BELOW = 6


#: More than any rank.
NO_RANK = np.uint64((1 << 64) - 1)


def ordered(seq: np.ndarray, at: np.ndarray, after: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(pairs, places, left out, bits): the pairs that begin at the places `at` and go on at `after`, ascending
    by pair and place; of pairs that overlap themselves (aaa) the second, fourth, ... of a run are left out."""
    bits, place = (top - 1).bit_length(), (len(seq) - 1).bit_length()
    a, b = seq.take(at), seq.take(after)
    twin = np.flatnonzero(a == b)
    if len(twin):
        nth, new = np.arange(len(twin)), np.ones(len(twin), bool)
        np.not_equal(after.take(twin[:-1]), at.take(twin[1:]), out=new[1:])
        nth -= np.maximum.accumulate(np.where(new, nth, 0))
        twin = twin.take(np.flatnonzero(nth & 1))
    out = at.take(twin)
    pairs = a.astype(np.uint64)
    pairs <<= np.uint64(bits)
    pairs |= b
    if 2 * bits + place > 64:  # does not fit beside the place
        pairs, at = np.delete(pairs, twin), np.delete(at, twin)
        order = np.argsort(pairs, kind="stable")
        return pairs[order], at[order], out, bits
    pairs <<= np.uint64(place)
    pairs |= at.view(np.uint64)
    pairs[twin] = NO_RANK  # as large as any, so that they come last
    pairs.sort()
    pairs = pairs[: len(pairs) - len(twin)]
    places = pairs & np.uint64((1 << place) - 1)
    pairs >>= np.uint64(place)
    return pairs, places.view(np.int64), out, bits


def ranks(pairs: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """Different numbers for different pairs, smaller ones for larger sizes (63 at most)."""
    wide = np.uint64((1 << 58) - 1)
    if 2 * bits <= 58:  # an odd factor keeps different numbers different
        return ((np.uint64(63) - size) << np.uint64(58)) | ((pairs * np.uint64(0x9E3779B97F4A7C15)) & wide)
    out = np.empty(len(pairs), np.uint64)
    out[np.lexsort((pairs * np.uint64(0x9E3779B97F4A7C15), -size.astype(np.int64)))] = np.arange(len(pairs))
    return out


def counted(pairs: np.ndarray, places: np.ndarray, bits: int):
    """Of ascending pairs: (places of those that occur once, places of the others, which of these pairs stands
    there, these pairs, their ranks)."""
    new = np.ones(len(pairs) + 1, bool)
    np.not_equal(pairs[1:], pairs[:-1], out=new[1:-1])
    once = new[1:] & new[:-1]
    many = np.flatnonzero(~once)
    first = new.take(many)
    begin = np.flatnonzero(first)
    kinds, times = pairs.take(many.take(begin)), np.diff(begin, append=len(many))
    # the smallest rank is the most frequent's; among about equal frequencies a hash decides, so that in a
    # chain of overlapping pairs many are kept at once
    rank = ranks(kinds, np.floor(2 * np.log2(times)).astype(np.uint64), bits)
    return places.take(np.flatnonzero(once)), places.take(many), np.cumsum(first) - 1, kinds, rank


def repair(ids: np.ndarray, sizes: np.ndarray):
    """(sequence, symbols of each document, left, right, rules made up to each pass, first nonterminal).

    Each pass counts all adjacent pairs and gives every pair that occurs twice or more a nonterminal; where
    two such pairs overlap, the one of better rank is replaced: the more frequent, to a factor of about 1.4.
    A pair with fewer than two places left waits for the next pass. Passes repeat, with pairs of nonterminals
    too, until no pair occurs twice. While most places change, the sequence closes up after each pass; later
    passes leave it as it is, link over what is gone, and read only places whose pair may occur twice.
    """
    seq = ids.astype(np.uint32)
    base = int(seq.max(initial=0)) + 1
    doc_end = np.zeros(len(seq), bool)
    if len(seq):
        doc_end[np.cumsum(sizes)[sizes > 0] - 1] = True
    left, right, passes, top = [], [], [], base

    def rules(at: np.ndarray, who: np.ndarray, kinds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Makes rules of the pairs that have two places, and returns these places with their new symbols."""
        nonlocal top
        uses = np.bincount(who, minlength=len(kinds))
        enough = uses >= 2
        name, made = np.cumsum(enough) + (top - 1), kinds.take(np.flatnonzero(enough))
        left.append((made >> np.uint64(bits)).astype(np.uint32))
        right.append((made & np.uint64((1 << bits) - 1)).astype(np.uint32))
        top += len(made)
        passes.append(top - base)
        some = np.flatnonzero(enough.take(who))
        return at.take(some), name.take(who.take(some)).astype(np.uint32)

    # places where no pair begins that can become a rule: the last symbol of a document has no partner, and a
    # pair that occurs once will not occur twice later
    lone = doc_end.copy()
    while len(todo := np.flatnonzero(~lone)) * LINK_BELOW >= len(seq) > 0:
        pairs, places, _, bits = ordered(seq, todo, todo + 1, top)
        once, places, who, kinds, rank = counted(pairs, places, bits)
        if not len(kinds):
            todo = todo[:0]
            break
        lone[once] = True
        # equal pairs never stand side by side: a place is kept if no neighbouring place has a better rank
        around = np.full(len(seq) + 2, NO_RANK)
        want = around[1:-1]
        want[places] = rank.take(who)
        best = want < around[:-2]
        best &= want < around[2:]
        keep = np.flatnonzero(best.take(places))
        at, symbols = rules(places.take(keep), who.take(keep), kinds, bits)
        seq[at] = symbols
        doc_end[at] = doc_end.take(at + 1)
        lone[at], lone[at[at > 0] - 1] = False, False
        lone |= doc_end
        gone = np.zeros(len(seq), bool)
        gone[at + 1] = True
        stay = np.flatnonzero(~gone)
        seq, doc_end, lone = seq.take(stay), doc_end.take(stay), lone.take(stay)
    n = len(seq)
    after, before, gone = np.arange(1, n + 1), np.arange(-1, n), np.zeros(n, bool)
    # the last of these is also the one before the first: no pair there
    want, mark = np.full(n + 1, NO_RANK), np.zeros(n + 1, bool)
    while len(todo):
        pairs, places, out, bits = ordered(seq, todo, after.take(todo), top)
        _, places, who, kinds, rank = counted(pairs, places, bits)
        if not len(kinds):
            break
        want[places] = rank = rank.take(who)
        keep = np.flatnonzero((rank < want.take(before.take(places), mode="wrap")) & (rank < want.take(after.take(places))))
        want[places] = NO_RANK
        at, symbols = rules(places.take(keep), who.take(keep), kinds, bits)
        seq[at] = symbols
        right_of = after.take(at)
        gone[right_of] = True
        doc_end[at] = doc_end.take(right_of)
        after[at] = follow = after.take(right_of)
        before[follow] = at
        mark[places] = mark[out] = mark[at] = mark[before.take(at)] = True
        maybe = np.flatnonzero(mark[:-1])
        mark[maybe] = mark[-1] = False
        todo = maybe.take(np.flatnonzero(~(gone.take(maybe) | doc_end.take(maybe))))
    stay = np.flatnonzero(~gone)
    seq, doc_end = seq.take(stay), doc_end.take(stay)
    ends = np.flatnonzero(doc_end) + 1
    symbols = np.zeros(len(sizes), np.int64)
    symbols[sizes > 0] = np.diff(ends, prepend=0)
    empty = np.zeros(0, np.uint32)
    return seq, symbols, np.concatenate(left or [empty]), np.concatenate(right or [empty]), np.array(passes, np.uint32), base


def columns(bits: int):
    """Of eight values that stand side by side in as many bytes as each has bits: (value, the 64-bit word
    that holds bits of it, how far left it stands there; negative: the lowest bits are in the next word)."""
    for j in range(8):
        for word in range(j * bits // 64, (j * bits + bits - 1) // 64 + 1):
            yield j, word, 64 * (word + 1) - (j + 1) * bits


def to_bits(values: np.ndarray, bits: int) -> bytes:
    """The lowest `bits` of each value, one after the other."""
    if not len(values):
        return b""
    rows = np.zeros((-(-len(values) // 8), 8), np.uint64)
    rows.reshape(-1)[: len(values)] = values & np.uint32((1 << bits) - 1)
    out = np.zeros((len(rows), -(-bits // 8)), np.uint64)
    for j, word, left in columns(bits):
        out[:, word] |= rows[:, j] << np.uint64(left) if left >= 0 else rows[:, j] >> np.uint64(-left)
    return out.astype(">u8").view(np.uint8)[:, :bits].tobytes()[: (len(values) * bits + 7) // 8]


def from_bits(data: bytes, n: int, bits: int, at: int) -> tuple[np.ndarray, int]:
    """(n values, where they end in data)."""
    size, rows = (n * bits + 7) // 8, -(-n // 8)
    packed = np.zeros(rows * bits, np.uint8)
    packed[:size] = np.frombuffer(data, np.uint8, size, at)
    wide = np.zeros((rows, 8 * -(-bits // 8)), np.uint8)
    wide[:, :bits] = packed.reshape(rows, bits)
    words, out = wide.view(">u8").astype(np.uint64), np.zeros((rows, 8), np.uint64)
    for j, word, left in columns(bits):
        out[:, j] |= words[:, word] >> np.uint64(left) if left >= 0 else words[:, word] << np.uint64(-left)
    return (out.ravel()[:n] & np.uint64((1 << bits) - 1)).astype(np.uint32), at + size


def to_shard(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """The payload of one shard: documents of sizes[i] ids each."""
    seq, symbols, left, right, passes, base = repair(ids, sizes)
    lengths, done = np.ones(base + len(left), np.uint32), 0
    for to in passes:
        lengths[base + done : base + to] = lengths[left[done:to]] + lengths[right[done:to]]
        done = int(to)
    lengths = lengths[base:]
    long, bits = lengths[lengths >= 255], (base + len(left)).bit_length()
    head = HEAD.pack(MAGIC, len(sizes), len(left), len(seq), base, len(passes), len(long))
    tables = [np.asarray(x).astype("<u4").tobytes() for x in (passes, symbols, sizes)]
    return b"".join([head, *tables, np.minimum(lengths, 255).astype(np.uint8).tobytes(), long.astype("<u4").tobytes(), to_bits(left, bits), to_bits(right, bits), to_bits(seq, bits)])


class Shard:
    """Reads a payload; document(i) expands only that document, span(i, low, high) only those ids of it."""

    def __init__(self, data: bytes):
        magic, docs, rules, n, self.base, passes, long = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at, parts = HEAD.size, []
        for k in (passes, docs, docs):
            parts.append(np.frombuffer(data, "<u4", k, at))
            at += 4 * k
        self.passes, self.symbols, self.sizes = parts
        self.lengths = np.frombuffer(data, np.uint8, rules, at).astype(np.int64)
        self.lengths[self.lengths == 255] = np.frombuffer(data, "<u4", long, at + rules)
        at, bits = at + rules + 4 * long, (self.base + rules).bit_length()
        self.left, at = from_bits(data, rules, bits, at)
        self.right, at = from_bits(data, rules, bits, at)
        self.seq, _ = from_bits(data, n, bits, at)
        self.starts = np.concatenate([[0], np.cumsum(self.symbols, dtype=np.int64)])

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """Nonterminals become their pairs, the latest pass first."""
        for k in range(len(self.passes) - 1, -1, -1):
            low = self.base + (int(self.passes[k - 1]) if k else 0)
            big = seq >= low
            at = np.flatnonzero(big)
            if not len(at):
                continue
            to = at + np.arange(len(at))
            out = np.empty(len(seq) + len(at), np.uint32)
            put = np.ones(len(out), bool)
            put[to + 1] = False
            rule = seq[at] - self.base
            out[put] = seq
            out[to], out[to + 1] = self.left[rule], self.right[rule]
            seq = out
        return seq

    def sizes_of(self, seq: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for, from the stored lengths."""
        out = np.ones(len(seq), np.int64)
        rule = seq >= self.base
        out[rule] = self.lengths[seq[rule] - self.base]
        return out

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.seq[self.starts[i] : self.starts[i + 1]])

    def span(self, i: int, low: int, high: int) -> np.ndarray:
        """Ids low to high - 1 of document i. The stored lengths say which symbols hold them; only the first
        and the last of these are followed down, rule by rule, to where the span begins and ends."""
        low, high = max(low, 0), min(high, int(self.sizes[i]))
        if low >= high:
            return np.zeros(0, np.uint32)
        seq = self.seq[self.starts[i] : self.starts[i + 1]]
        ends = np.cumsum(self.sizes_of(seq))
        first, last = int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(ends, high))
        skip, left = low - (int(ends[first - 1]) if first else 0), high - low
        todo, out = seq[first : last + 1][::-1].tolist(), []
        while left:
            s = todo.pop()
            n = 1 if s < self.base else int(self.lengths[s - self.base])
            if skip >= n:
                skip -= n
            elif not skip and n <= left:
                out.append(s)
                left -= n
            else:
                todo += [int(self.right[s - self.base]), int(self.left[s - self.base])]
        return self.expand(np.array(out, np.uint32))

    def documents(self) -> Iterator[bytes]:
        """All documents in order, as little-endian uint32 bytes."""
        data, end = self.expand(self.seq).astype("<u4").tobytes(), 0
        for n in self.sizes.tolist():
            yield data[end : end + 4 * n]
            end += 4 * n


SHARDS = "part int, shard int, doc_ids array<long>, n_ids long, payload binary"


def write_shards(tokenizer: str, end: int, shard_ids: int):
    last = np.array([end], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, shard = encoder(tokenizer, "byte"), TaskContext.get().partitionId(), 0
        docs, data, size = [], [], 0
        hoard()

        def flush():
            ids = np.frombuffer(b"".join(data), np.uint32)
            payload = to_shard(ids, np.array([len(x) // 4 for x in data], np.int64))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "shard", "doc_ids", "n_ids", "payload"])

        for rows in enc.encode_rows(batches):
            for doc, ids in zip(*rows):
                docs.append(doc)
                data.append(ids + last)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield flush()
                    docs, data, size, shard = [], [], 0, shard + 1
        if docs:
            yield flush()
        trim()

    return run


def write_ids(docs: DataFrame, tokenizer: str, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes the texts in ascending doc_id order and writes the shards to the shared folder; returns the
    written table: part, shard (both ascending with doc_id), doc_ids, n_ids, payload.

    Null doc_ids come first; null and empty texts are the end id alone; rows of the same doc_id are
    documents of their own, in the order of their texts' hashes; a row's number parts rows that repeat whole
    among the tasks. Other columns are not read.
    """
    tune(docs.sparkSession)
    keyed = need(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(parts_for(docs, 8 << 20), "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    return materialise(ordered.select("doc_id", "text").mapInArrow(write_shards(tokenizer, end, shard_ids), SHARDS), "ids")


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hoard()
    for b in batches:
        for part, shard, docs, payload in zip(*[b.column(i).to_pylist() for i in range(4)]):
            ids = list(Shard(payload).documents())
            n = np.array([len(x) // 4 for x in ids], np.int64)
            k = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array([shard] * k, pa.int32()), pa.array(docs, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"])
    trim()


def read_digest(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the written shards."""
    # shards are counted by part first, so that no window holds more than the parts or one part's shards
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS part_start")
    inner = shards.selectExpr("part", "shard", "sum(n_ids) OVER (PARTITION BY part ORDER BY shard) - n_ids AS shard_start")
    starts = inner.join(before, "part").selectExpr("part", "shard", "part_start + shard_start AS start")
    docs = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(read_back, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
