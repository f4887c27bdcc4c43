"""Removal of long repeated byte strings, found by suffix arrays.

1. Anchors. Every window of `length` bytes picks the position of its smallest GRAM-byte hash. Equal windows
   pick equal positions, so a window that repeats has an anchor whose gram repeats. Consecutive windows
   mostly share an anchor; its context is all their bytes.
2. Blocks of documents send each distinct (gram hash, context hash) pair once, packed, to hash ranges. A
   context that is there twice is a repeat as a whole: equal strings are merged before any sorting. A gram
   that is there once is none. Left are grams with several different contexts; one block sends the bytes
   of each such context.
3. A range of these contexts is cut into 16-byte symbols, aligned at the anchors, and sorted by a suffix
   array. Windows that are equal share eleven symbols or more from the first symbol border in them, so they
   lie side by side in a run of the suffix array; an exact comparison inside the runs settles each window.
4. The blocks join what repeats and cut it out.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefixes, the groups
handled in descending order with pointers to the previous smaller suffix, and then each group's order is
emitted in one ascending pass. Nothing is renamed and nothing recurs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_edges, mix, need, pack, parts_for, release, trim, tune, unpack

LENGTH = 200
GRAM = 128
SYMBOL = 16
#: Texts of a block, in bytes of the stored table, and bytes hashed at a time.
BLOCK_BYTES, SLAB = 5 << 20, 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of symbols (ints > 0) in ascending order; a suffix is smaller than what it begins."""
    s = [*symbols, 0]
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, last = [0] * n, [0] * n, [0] * n  # last: of the group that starts here
    start = 0
    for k, i in enumerate(order):
        if s[i] != s[order[start]]:
            start = k
        place[i], group[i], last[start] = k, start, k
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        first = group[order[end]]
        if first == end:  # one suffix
            i = order[end]
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = prev[j]
            prev[i] = j
            levels = [[j]] if j >= 0 else []
        else:
            members = sorted(order[first : end + 1])
            times: dict[int, int] = {}
            for i in members:
                j = i - 1
                while j >= 0 and group[j] >= first:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            if not times:
                levels = []
            elif (most := max(times.values())) == 1:
                levels = [list(times)]
            else:
                levels = [[] for _ in range(most)]
                for j, k in times.items():
                    levels[most - k].append(j)
        # a suffix followed by k of the group's Lyndon words goes behind those of its group with fewer
        for level in levels:
            moved: dict[int, int] = {}
            for j in level:
                g = group[j]
                m = moved.get(g, 0)
                to, at = last[g] - m, place[j]
                other = order[to]
                order[at], order[to], place[other], place[j] = other, j, at, to
                moved[g] = m + 1
            for g, m in moved.items():
                new = last[g] - m + 1
                if new != g:
                    last[new], last[g] = last[g], new - 1
                    for k in range(new, new + m):
                        group[order[k]] = new
        end = first - 1
    free = list(range(n))  # of the group that starts here: the next place
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
    return out[1:]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up = np.full(n, BASE & (2**64 - 1), np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, scale): (sums[e] - sums[s]) * scale[s] hashes data[s:e], wherever it stands."""
    if not _powers or len(_powers[0][0]) <= len(data):
        _powers[:] = [powers(max(SLAB * 2, len(data) + 1))]
    up, down = _powers[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


class Texts:
    """A block's texts as one byte array, in an order that does not depend on how the rows arrived."""

    def __init__(self, table: pa.Table):
        self.order = np.lexsort((table.column(MARK).to_numpy(), table.column("doc_id").cast(pa.int64()).fill_null(-(2**63)).to_numpy()))
        table = table.select(["doc_id", "text"]).take(pa.array(self.order))
        self.ids = table.column("doc_id").combine_chunks()
        text = table.column("text").cast(pa.large_binary()).fill_null(b"").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks)
        self.ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1].copy()
        raw = text.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[self.ends[0] : self.ends[-1]] if raw is not None and self.ends[-1] > self.ends[0] else np.zeros(0, np.uint8)
        self.ends -= self.ends[0]

    def anchors(self, length: int, gram: int):
        """Arrays (gram hash, context hash, first window, last window, anchor) over the block, ascending."""
        out, doc = [], 0
        while doc < len(self.ends) - 1:
            to = doc + 1
            while to < len(self.ends) - 1 and self.ends[to + 1] - self.ends[doc] <= SLAB:
                to += 1
            if self.ends[to] - self.ends[doc] >= length:
                out.append(self.slab(doc, to, length, gram))
            doc = to
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3

    def slab(self, doc: int, to: int, length: int, gram: int):
        base = int(self.ends[doc])
        data = self.data[base : self.ends[to]]
        sums, scale = prefix_hash(data)
        grams = mix((sums[gram:] - sums[:-gram]) * scale[: len(data) - gram + 1])
        bits = np.uint64((len(data) - 1).bit_length())
        best = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have * 2 <= width:
            best = np.minimum(best[: len(best) - have], best[have:])
            have *= 2
        if have < width:
            best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
        at = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the window that starts here
        ends = self.ends[doc + 1 : to + 1] - base
        left = np.repeat(ends, np.diff(self.ends[doc : to + 1]))[: len(at)] - np.arange(len(at))
        fits = left >= length
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | ~fits[:-1]
        first = np.flatnonzero(new & fits)
        stop = np.append(np.flatnonzero(new | ~fits), len(at))
        last = stop[np.searchsorted(stop, first, side="right")] - 1
        p = at[first]
        context = mix((sums[last + length] - sums[first]) * scale[first] + np.uint64(0x51ED) * (last - first).astype(np.uint64) + (p - first).astype(np.uint64))
        return mix(grams[p] + np.uint64(7)), context, first + base, last + base, p + base


PAIRS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("grams", pa.binary()), ("contexts", pa.binary()), ("times", pa.binary())])


def pairs_of(f: np.ndarray, c: np.ndarray):
    """Distinct (f, c), ascending, with counts; and for each row the number of its pair."""
    order = np.lexsort((c, f))
    sf, sc = f[order], c[order]
    new = np.ones(len(f), bool)
    new[1:] = (sf[1:] != sf[:-1]) | (sc[1:] != sc[:-1])
    number = np.empty(len(f), np.int64)
    number[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return sf[at], sc[at], np.diff(np.append(at, len(f))), number


def send_pairs(length: int, gram: int, buckets: int):
    edges = bucket_edges(buckets)

    def run(table: pa.Table) -> pa.Table:
        release()
        f, c, *_ = Texts(table).anchors(length, gram)
        f, c, n, _ = pairs_of(f, c)
        trim()
        cut = np.append(np.searchsorted(f, edges), len(f))
        b = [i for i in range(buckets) if cut[i] < cut[i + 1]]
        part = [slice(cut[i], cut[i + 1]) for i in b]
        return pa.table([pa.array(b, pa.int32()), pa.array([table.column(BLOCK)[0].as_py()] * len(b), pa.int32()), pa.array([pack(f[x]) for x in part], pa.binary()), pa.array([c[x].tobytes() for x in part], pa.binary()), pa.array([np.minimum(n[x], 2).astype(np.uint8).tobytes() for x in part], pa.binary())], schema=PAIRS)

    return run


STATES = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("states", pa.binary())])
REPEATS, SENDS = 1, 2


def judge_pairs(table: pa.Table) -> pa.Table:
    """For each block and pair a byte: REPEATS if the context is there twice, SENDS if this block sends its
    bytes (the gram has several contexts, and the block is the first with this one)."""
    blocks = table.column("block").to_pylist()
    fs = [unpack(x) for x in table.column("grams").to_pylist()]
    f, c = np.concatenate(fs), np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("contexts").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("times").to_pylist()]).astype(np.int64)
    which = np.repeat(blocks, [len(x) for x in fs])
    order = np.lexsort((which, c, f))
    sf, sc = f[order], c[order]
    new_f = np.ones(len(f), bool)
    new_f[1:] = sf[1:] != sf[:-1]
    new = new_f.copy()
    new[1:] |= sc[1:] != sc[:-1]
    pair, gram = np.cumsum(new) - 1, np.cumsum(new_f) - 1
    times = np.bincount(pair, n[order])
    kinds = np.bincount(gram, new)
    state = np.zeros(len(f), np.uint8)
    state[order] = REPEATS * (times[pair] >= 2) + SENDS * (new & (kinds[gram] >= 2))
    ends = np.cumsum([0, *map(len, fs)])
    return pa.table([pa.array(blocks, pa.int32()), table.column("bucket"), pa.array([state[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], schema=STATES)


#: kind 0: a block's own ranges, passed through; kind 1: contexts.
CONTEXTS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("starts", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("own", pa.bool_())])


def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching ranges."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(ends)) - 1] if len(ends) else ends


def send_contexts(length: int, gram: int, buckets: int):
    edges = bucket_edges(buckets)

    def run(table: pa.Table, states: pa.Table) -> pa.Table:
        if not table.num_rows:
            return CONTEXTS.empty_table()
        texts, block = Texts(table), table.column(BLOCK)[0].as_py()
        f, c, first, last, p = texts.anchors(length, gram)
        pf, _, _, number = pairs_of(f, c)
        states = states.sort_by("bucket")
        state = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in states.column("states").to_pylist())])
        if len(state) != len(pf):
            raise ValueError("a block's texts changed between two reads")
        s = state[number]
        low, high = merge_ranges(first[s & REPEATS > 0], last[s & REPEATS > 0] + length)
        rows = [(block % buckets, block, low.astype("<i8").tobytes(), high.astype("<i8").tobytes(), b"", True)]
        once = np.zeros(len(f), bool)
        once[np.unique(number, return_index=True)[1]] = True
        send = np.flatnonzero((s & SENDS > 0) & once)
        send = send[np.argsort(f[send], kind="stable")]
        cut = np.append(np.searchsorted(f[send], edges), len(send))
        for b in range(buckets):
            mine = send[cut[b] : cut[b + 1]]
            if len(mine):
                size = np.stack([last[mine] - first[mine], p[mine] - first[mine]], 1).astype("<u2")
                data = b"".join(texts.data[x : y + length].tobytes() for x, y in zip(first[mine].tolist(), last[mine].tolist()))
                rows.append((b, block, first[mine].astype("<i8").tobytes(), size.tobytes(), data, False))
        return pa.table([pa.array(x, t.type) for x, t in zip(zip(*rows), CONTEXTS)], schema=CONTEXTS)

    return run


def repeated_windows(data: np.ndarray, sizes: np.ndarray, length: int, symbol: int = SYMBOL) -> tuple[np.ndarray, np.ndarray]:
    """data: contexts one after the other; sizes: (last window, anchor) of each, from its start. Returns
    (context, window) of every window whose bytes are those of another window.

    The suffix array over the contexts' symbols brings together what may be equal; bytes decide.
    """
    whole = sizes[:, 0] + length
    starts = np.cumsum(whole) - whole
    lead = sizes[:, 1] % symbol  # bytes before the first symbol border
    count = (whole - lead) // symbol
    total = int(count.sum())
    ctx = np.repeat(np.arange(len(whole)), count)
    nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    border = starts[ctx] + lead[ctx] + nth * symbol
    blocks = np.lib.stride_tricks.sliding_window_view(data, symbol)[border].copy().view("<u8").reshape(-1, symbol // 8)
    order = np.lexsort(blocks.T)
    new = np.ones(total, bool)
    new[1:] = (blocks[order[1:]] != blocks[order[:-1]]).any(1)
    rank = np.empty(total, np.int64)
    rank[order] = np.cumsum(new) + 1
    # 1 stands between contexts
    at = np.arange(total) + ctx
    text = np.ones(total + len(whole), np.int64)
    text[at] = rank
    sa = np.array(suffix_array(text.tolist()), np.int64)
    share = (length - symbol + 1) // symbol  # symbols that equal windows share at least
    back = np.full(len(text), -1, np.int64)
    back[at] = np.arange(total)
    # borders from which a window of this context can count its symbols: those up to the anchor
    able = np.zeros(len(text), bool)
    able[at] = (nth * symbol + lead[ctx] <= sizes[ctx, 1] + 0) & (nth + share <= count[ctx])
    padded = np.concatenate([text, np.zeros(share, np.int64)])
    same = np.ones(len(sa), bool)
    same[0] = False
    for j in range(share):
        same[1:] &= padded[sa[1:] + j] == padded[sa[:-1] + j]
    run = np.cumsum(~same)
    keep = able[sa]
    sa, run = sa[keep], run[keep]
    big = np.bincount(run)[run] > 1
    sa, run = back[sa[big]], run[big]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # windows that start in the symbol before a border, or at it
    sums, scale = prefix_hash(data)
    c, b = np.repeat(ctx[sa], symbol), np.repeat(border[sa], symbol)
    w = b - np.tile(np.arange(symbol), len(sa))
    r = np.repeat(run, symbol) * symbol + np.tile(np.arange(symbol), len(sa))
    fine = (w >= starts[c]) & (w <= starts[c] + sizes[c, 0])
    c, w, r = c[fine], w[fine], r[fine]
    h = mix((sums[w + length] - sums[w]) * scale[w])
    by = np.lexsort((h, r))
    eq = (h[by[1:]] == h[by[:-1]]) & (r[by[1:]] == r[by[:-1]])
    # the exact check: neighbours of equal hash must be equal in all their bytes
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    for low in range(0, len(eq), 1 << 14):
        e = np.flatnonzero(eq[low : low + (1 << 14)]) + low
        eq[e] = (view[w[by[e]]] == view[w[by[e + 1]]]).all(1)
    hit = np.zeros(len(by), bool)
    hit[by[1:][eq]] = hit[by[:-1][eq]] = True
    return c[hit], w[hit] - starts[c[hit]]


RANGES = pa.schema([("block", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])


def sort_contexts(length: int):
    def run(table: pa.Table) -> pa.Table:
        rows, blocks, starts, sizes, data = [], [], [], [], []
        for _, block, first, size, text, own in zip(*[table.column(f.name).to_pylist() for f in CONTEXTS]):
            if own:
                rows.append((block, first, size))
                continue
            starts.append(np.frombuffer(first, "<i8"))
            sizes.append(np.frombuffer(size, "<u2").reshape(-1, 2).astype(np.int64))
            blocks.append(np.full(len(starts[-1]), block))
            data.append(text)
        if data:
            c, w = repeated_windows(np.frombuffer(b"".join(data), np.uint8), np.concatenate(sizes), length)
            at, block = np.concatenate(starts)[c] + w, np.concatenate(blocks)[c]
            for b in np.unique(block):
                low, high = merge_ranges(at[block == b], at[block == b] + length)
                rows.append((int(b), low.astype("<i8").tobytes(), high.astype("<i8").tobytes()))
        return pa.table([pa.array(x, t.type) for x, t in zip(zip(*rows) if rows else [[]] * 3, RANGES)], schema=RANGES)

    return run


def kept_parts(t: Texts, ranges: pa.Table):
    """For each text: whether each byte goes."""
    low = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(x, "<i8") for x in ranges.column("low").to_pylist())])
    high = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(x, "<i8") for x in ranges.column("high").to_pylist())])
    step = np.zeros(len(t.data) + 1, np.int32)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    gone = np.cumsum(step[:-1]) > 0
    for a, b in zip(t.ends[:-1].tolist(), t.ends[1:].tolist()):
        yield t.data[a:b], gone[a:b]


def digest_cuts(table: pa.Table, ranges: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    if not table.num_rows:
        return schema.empty_table()
    t, rows = Texts(table), []
    trim()
    for doc, (data, gone) in zip(t.ids.to_pylist(), kept_parts(t, ranges)):
        removed = int(np.count_nonzero(gone))
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]) if removed else 0
        rows.append((doc, len(data), removed, spans, hashlib.sha256((data[~gone] if removed else data).tobytes()).hexdigest()))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def cut_texts(table: pa.Table, ranges: pa.Table) -> pa.Table:
    """The rows with their texts cut; a character that a cut splits goes as a whole, a null text stays null."""
    rows = table.drop_columns([MARK, BLOCK])
    if not table.num_rows:
        return rows
    t = Texts(table)
    rows = rows.take(pa.array(t.order))
    null = rows.column("text").is_null().to_pylist()
    kept = [None if n else data[~gone].tobytes().decode(errors="ignore") for n, (data, gone) in zip(null, kept_parts(t, ranges))]
    return rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))


MARK, BLOCK = "fathom mark", "fathom block"


def repeats_of(docs: DataFrame, length: int):
    """The rows dealt to blocks, and the ranges that go from each block's bytes."""
    if length < GRAM + SYMBOL:
        raise ValueError(f"length must be {GRAM + SYMBOL} at least")
    tune(docs.sparkSession)
    blocks = buckets = parts_for(docs, BLOCK_BYTES)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = docs.withColumn(MARK, F.xxhash64("text")).withColumn(BLOCK, block).repartition(blocks, BLOCK)
    by_block = rows.groupBy(BLOCK)
    pairs = by_block.applyInArrow(send_pairs(length, GRAM, buckets), "bucket int, block int, grams binary, contexts binary, times binary")
    states = pairs.groupBy("bucket").applyInArrow(judge_pairs, "block int, bucket int, states binary")
    contexts = by_block.cogroup(states.groupBy("block")).applyInArrow(send_contexts(length, GRAM, buckets), "bucket int, block int, starts binary, sizes binary, data binary, own boolean")
    ranges = contexts.groupBy("bucket").applyInArrow(sort_contexts(length), "block int, low binary, high binary")
    return by_block, ranges.groupBy("block")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document.

    Every byte that a `length`-byte string covers which also starts elsewhere, in the same or another text,
    is removed; all is judged on the texts as given. Null and empty texts are 0 bytes; shorter texts than
    `length` stay whole; long texts are read whole; rows that repeat, with a doc_id or without, are texts of
    their own and each loses what the other has; an empty table gives no rows. Columns other than doc_id and
    text are not read. `length` is 144 at least.
    """
    rows, ranges = repeats_of(need(docs, "doc_id", "text"), length)
    return rows.cogroup(ranges).applyInArrow(digest_cuts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs, with all their columns, with what remove_repeats() removes cut from their texts."""
    rows, ranges = repeats_of(docs, length)
    return rows.cogroup(ranges).applyInArrow(cut_texts, docs.schema)
