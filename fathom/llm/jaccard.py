"""Near-duplicate documents by an exact Jaccard join on word n-grams with adaptive multi-match prefixes.

1. Blocks of documents hash their distinct shingles and send them, sorted and packed, to hash ranges; a
   range counts each shingle's document frequency over all blocks and sends back only those in two
   documents or more. (A shingle of one document can be no part of any intersection.) A shingle that is
   frequent inside a block is sent as a count, and its list of documents stays with the block.
2. All shingles have one global order: rare first. If two documents have an overlap of t, the first n - t + l
   shingles of both share l at least. Each document picks its own l: a longer prefix meets more documents but
   asks for more shared shingles; estimated candidate cost decides. A pair with prefixes l and m must share
   min(l, m) in them. The first of these is among the first n - t + 1 of both: only those are indexed.
3. The index lists the documents of each indexed shingle; equal lists are one. A task takes one list, or a
   chunk of a long one with the documents that visit it, counts the shared prefix shingles of each pair,
   verifies the pairs that share enough and returns only edges of a spanning forest, never the pairs. First,
   every document is compared inside its two longest lists, chunk by chunk, which links most copies. Then
   come the lists that still hold several components: there, documents of different components are compared,
   each pair in the first list that it shares. Documents outside a long list's largest component visit all its
   chunks; those inside stay in theirs.
4. Connected components of the forests are the duplicate classes.

Documents with equal sets are one class before step 3, so that copies cost one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_bytes, bucket_edges, connected_components, free_name, materialise, mix, need, pack, parts_for, release, trim, tune, unpack, word_hashes, words_of

WORDS = 5
PERCENT = 80
#: Words of a block and documents of a block, at most; a longer document is a block of its own.
BLOCK_WORDS, BLOCK_DOCS = 3 << 18, 30_000
#: A shingle that so many documents of one block hold is sent as a count.
HEAVY = 64
#: Bits of a shingle's hash that travel.
HASH_BITS = 52
#: Longest prefix extension tried, and the cost of verifying one shingle against reading one posting.
MOST_MATCHES, VERIFY_COST = 16, 0.05
#: Documents of a chunk of a list, on average, and of the visitors that are compared with it at a time.
CHUNK = 128
#: Lists of each document that are read before the others.
FIRST = 2
STEP = np.uint64(0x9E3779B97F4A7C15)
DROP = np.uint64(64 - HASH_BITS)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of texts with the given word hashes and word counts, and each one's
    text. A text of fewer words has its whole sequence, hashed with its length, as its only shingle."""
    text = np.repeat(np.arange(len(counts)), counts)
    acc = np.zeros(len(words), np.uint64)
    part = acc.copy()
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the text's end
    size = np.repeat(counts, counts)
    for j in range(k):
        end = len(words) - j
        acc[:end] = mix(acc[:end] * STEP + words[j:] + np.uint64(j))
        part[left == j + 1] = acc[left == j + 1]
    first = left == size
    short = first & (size < k)
    if short.any():
        acc[short] = mix(part[short] + np.uint64(k) * size[short].astype(np.uint64))
    use = (left >= k) | short
    return acc[use], text[use]


class Block:
    """Gathers documents, then writes a block's rows."""

    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("light", pa.binary()), ("light_doc", pa.binary()), ("heavy", pa.binary()), ("heavy_n", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("marks", pa.binary()), ("lists", pa.binary())])

    def __init__(self, k: int, buckets: int, most: int = BLOCK_WORDS):
        self.k, self.buckets, self.most, self.edges = k, buckets, most, bucket_edges(buckets) >> DROP
        self.ids, self.hashes, self.counts, self.size = [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        words, counts = words_of(texts)
        self.ids.extend(ids.to_pylist())
        self.hashes.append(word_hashes(words))
        self.counts.append(counts)
        self.size += len(words)

    def rows(self, block: int) -> pa.RecordBatch:
        n_docs = len(self.ids)
        g, doc = shingles(np.concatenate(self.hashes), np.concatenate(self.counts), self.k)
        order = np.argsort(g, kind="stable")
        g, doc = g[order], doc[order]  # stable: within a shingle ascending by document
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[keep], doc[keep]
        sizes = np.bincount(doc, minlength=n_docs).astype("<i8")
        by_doc = np.argsort(doc, kind="stable")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        marks = np.empty((n_docs, 2), "<u8")  # 128 bits that say which set it is
        for i, salt in enumerate((1, 2)):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(g[by_doc] + np.uint64(salt)), dtype=np.uint64)])
            marks[:, i] = total[ends[1:]] - total[ends[:-1]]
        g >>= DROP
        first = np.flatnonzero(np.diff(g, prepend=~g[:1])) if len(g) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(g)))
        heavy = np.repeat(n >= HEAVY, n)
        hg, hn = g[first[n >= HEAVY]], n[n >= HEAVY].astype("<u4")
        lg, ld = g[~heavy], doc[~heavy].astype("<u2")
        cut, hcut = np.append(np.searchsorted(lg, self.edges), len(lg)), np.append(np.searchsorted(hg, self.edges), len(hg))
        b = range(self.buckets)
        home = block % self.buckets  # the block's own data passes through one bucket unchanged
        own = lambda x: [x if i == home else None for i in b]
        return pa.RecordBatch.from_arrays([
            pa.array(b, pa.int32()), pa.array([block] * len(b), pa.int64()),
            pa.array([pack(lg[cut[i] : cut[i + 1]]) for i in b], pa.binary()), pa.array([ld[cut[i] : cut[i + 1]].tobytes() for i in b], pa.binary()),
            pa.array([pack(hg[hcut[i] : hcut[i + 1]]) for i in b], pa.binary()), pa.array([hn[hcut[i] : hcut[i + 1]].tobytes() for i in b], pa.binary()),
            pa.array(own(self.ids), pa.list_(pa.int64())), pa.array(own(sizes.tobytes()), pa.binary()), pa.array(own(marks.tobytes()), pa.binary()),
            pa.array(own(doc[heavy].astype("<u2").tobytes()), pa.binary()),
        ], schema=self.schema)


def sketch(k: int, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, seq, block = TaskContext.get().partitionId(), 0, Block(k, buckets, most)
        for b in batches:
            for i in range(0, b.num_rows, 128):
                block.add(b.column(0).slice(i, 128), b.column(1).slice(i, 128))
                if block.size >= most or len(block.ids) >= BLOCK_DOCS:
                    yield block.rows(part << 16 | seq)
                    seq, block = seq + 1, Block(k, buckets, most)
        if block.ids:
            yield block.rows(part << 16 | seq)
        del block
        trim()

    return run


SHARED = pa.schema([("block", pa.int64()), ("light", pa.binary()), ("light_doc", pa.binary()), ("light_df", pa.binary()), ("heavy", pa.binary()), ("heavy_n", pa.binary()), ("heavy_df", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("marks", pa.binary()), ("lists", pa.binary()), ("bucket", pa.int32())])


def count_documents(table: pa.Table) -> pa.Table:
    """One hash range: document frequencies over all blocks; each block gets back what two documents hold."""
    col = lambda n: table.column(n).to_pylist()
    light, heavy = [unpack(x) for x in col("light")], [unpack(x) for x in col("heavy")]
    docs, heavy_n = [np.frombuffer(x, "<u2") for x in col("light_doc")], [np.frombuffer(x, "<u4") for x in col("heavy_n")]
    g = np.concatenate(light + heavy)
    weight = np.concatenate([np.ones(sum(map(len, light)), np.int64), *heavy_n])
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.diff(s, prepend=~s[:1]) != 0 if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    df = np.empty(len(g), np.int64)
    df[order] = np.add.reduceat(weight[order], first)[np.cumsum(new) - 1] if len(s) else 0
    df = np.minimum(df, 65535).astype("<u2")
    del g, weight, order, s, new, first
    trim()
    out: dict[str, list] = {"light": [], "light_doc": [], "light_df": [], "heavy_df": []}
    at = 0
    for h, d in zip(light, docs):
        f = df[at : at + len(h)]
        at += len(h)
        use = f >= 2
        out["light"].append(pack(h[use]))
        out["light_doc"].append(d[use].tobytes())
        out["light_df"].append(f[use].tobytes())
    for h in heavy:
        out["heavy_df"].append(df[at : at + len(h)].tobytes())
        at += len(h)
    return pa.table([pa.array(out[f.name], f.type) if f.name in out else table.column(f.name).cast(f.type) for f in SHARED], schema=SHARED)


PREFIXES = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("mark0", pa.int64()), ("mark1", pa.int64()), ("matches", pa.int32()), ("spare", pa.int32()), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary())])


def pick_matches(df: np.ndarray, spare: int, n: int) -> int:
    """How many shared prefix shingles a document asks for. df: frequencies of its shingles that others
    have, rare first; spare: how many of them the shortest prefix holds. Reading costs the postings of the
    prefix; verifying costs n for each candidate, of which there are at most postings / matches."""
    best, cost = 1, None
    read = np.cumsum(df[: spare + MOST_MATCHES - 1].astype(np.int64) - 1)
    for m in range(1, MOST_MATCHES + 1):
        if spare + m - 1 > len(read):
            break
        r = float(read[spare + m - 2])
        c = r + VERIFY_COST * n * r / m
        if cost is None or c < cost:
            best, cost = m, c
    return best


def prefixes(percent: int):
    def run(table: pa.Table) -> pa.Table:
        release()
        col = lambda n: table.column(n).to_pylist()
        table = table.sort_by("bucket")
        own = next(i for i, x in enumerate(col("docs")) if x is not None)
        block, ids, sizes = table.column("block")[0].as_py(), col("docs")[own], np.frombuffer(col("sizes")[own], "<i8")
        marks, lists = np.frombuffer(col("marks")[own], "<i8").reshape(-1, 2), np.frombuffer(col("lists")[own], "<u2")
        hg, hn = [unpack(x) for x in col("heavy")], np.concatenate([np.frombuffer(x, "<u4") for x in col("heavy_n")]).astype(np.int64)
        g = np.concatenate([unpack(x) for x in col("light")] + [np.repeat(np.concatenate(hg), hn)])
        doc = np.concatenate([*(np.frombuffer(x, "<u2") for x in col("light_doc")), lists]).astype(np.int64)
        df = np.concatenate([*(np.frombuffer(x, "<u2") for x in col("light_df")), np.repeat(np.concatenate([np.frombuffer(x, "<u2") for x in col("heavy_df")]), hn)])
        order = np.lexsort((g, df, doc))
        g, doc, df = g[order].astype(np.int64), doc[order], df[order]
        ends = np.searchsorted(doc, np.arange(len(ids) + 1))
        lone = sizes - np.diff(ends)  # shingles that no other document has come first in the order
        least = -(-sizes * percent // 100)
        spare = sizes - least + 1 - lone
        matches, index, prefix, shared = [], [], [], []
        for i in range(len(ids)):
            a, b = int(ends[i]), int(ends[i + 1])
            if a == b or spare[i] <= 0:
                matches.append(None), index.append(None), prefix.append(None), shared.append(None)
                continue
            m = pick_matches(df[a:b], int(spare[i]), int(sizes[i]))
            matches.append(m)
            index.append(min(b - a, int(spare[i])))
            prefix.append(g[a : min(b, a + int(spare[i]) + m - 1)])
            shared.append(pack(np.sort(g[a:b]).astype(np.uint64)))
        rid = block * 32768 + np.arange(len(ids))
        del g, doc, df, order
        trim()
        return pa.table([pa.array(rid), pa.array(ids, pa.int64()), pa.array(sizes), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(matches, pa.int32()), pa.array(index, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(shared, pa.binary())], schema=PREFIXES)

    return run


#: What a task reads of each document; rows come by (list, chunk), those whose own chunk this is first.
DEALT = ["list", "chunk", "own", "rid", "component", "minor", "n", "matches", "prefix", "shared", "lists"]


def link_lists(percent: int):
    """mapInArrow over rows of DEALT: links between documents of different components, as forests. lists: of
    each document, so that a pair is compared in the first that it shares; null: it is compared here."""

    def forest(rows: list, inside: int) -> list[tuple[int, int]]:
        """rows: first those of the chunk (`inside`: how many), then visitors; without visitors all pairs of the
        chunk, else those of a visitor and one of the chunk."""
        here, k = rows[0], len(rows)
        component, n = np.array([r[4] for r in rows]), np.array([r[6] for r in rows], np.int64)
        fits = (component[:, None] != component[None, :]) & np.tri(k, k, -1, dtype=bool)
        fits &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
        if inside < k:
            fits[:inside], fits[:, inside:] = False, False
            # two that visit each other's chunks are compared in the later one
            own, minor = np.array([r[2] for r in rows]), np.array([r[5] for r in rows])
            fits &= ~minor[None, :] | (own[:, None] < here[1])
        if not fits.any():
            return []
        used = np.flatnonzero(fits.any(0) | fits.any(1))
        fits, rows, n = fits[np.ix_(used, used)], [rows[i] for i in used], n[used]
        matches = np.array([r[7] for r in rows])
        fits &= product([r[8] for r in rows]) >= np.minimum.outer(matches, matches)
        if fits.any() and here[10] is not None:
            fits &= product([r[10][r[10] < here[0]] for r in rows]) == 0
        if not fits.any():
            return []
        used = np.flatnonzero(fits.any(0) | fits.any(1))
        fits, rows, n = fits[np.ix_(used, used)], [rows[i] for i in used], n[used]
        common = product([unpack(r[9]).astype(np.int64) for r in rows])
        links = fits & (100 * common >= percent * (np.add.outer(n, n) - common))
        root, out = list(range(len(rows))), []
        for a, b in zip(*np.nonzero(links)):
            x, y = int(a), int(b)
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((rows[a][3], rows[b][3]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, inside, visitors, edges = None, [], [], []

        def meet() -> None:
            if inside and visitors:
                edges.extend(forest(inside + visitors, len(inside)))
            visitors.clear()

        def close() -> None:
            meet()
            if len(inside) > 1:
                edges.extend(forest(inside, len(inside)))
            inside.clear()

        for b in batches:
            for r in zip(*[b.column(i).to_pylist() for i in range(len(DEALT))]):
                if r[:2] != key:
                    close()
                    key = r[:2]
                r = (*r[:8], np.array(r[8], np.int64), r[9], None if r[10] is None else np.array(r[10], np.int64))
                (inside if r[2] == r[1] else visitors).append(r)
                if len(visitors) >= CHUNK:
                    meet()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*edges) if edges else ([], []))], ["src", "dst"])
            edges.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*edges) if edges else ([], []))], ["src", "dst"])

    return run


def posting_lists(live: DataFrame) -> DataFrame:
    """rid, list, df: the lists that each document is in, of those with two documents or more; of equal lists
    one. Lists are numbered so that shorter ones come first."""
    post = live.select("rid", F.explode(F.slice("prefix", F.lit(1), F.col("spare"))).alias("token"))
    held = post.groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(7))).alias("y")).where("df > 1")
    number = F.shiftleft(F.least("df", F.lit((1 << 10) - 1)), HASH_BITS).bitwiseOR(F.col("token"))
    kept = held.groupBy("df", "x", "y").agg(F.min("token").alias("token")).select("token", "df", number.alias("list"))
    return post.join(kept, "token").select("rid", "list", "df")


def candidate_links(live: DataFrame, percent: int, parts: int) -> DataFrame:
    """src, dst: edges that connect all documents (rid, n, matches, spare, prefix, shared) which links connect."""
    mine = materialise(posting_lists(live), "lists")
    chunks = F.ceil(F.col("df") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("rid", "list"), F.col("chunks").cast("long")).cast("int")

    def linked(rows: DataFrame, tag: str) -> DataFrame:
        tasks = rows.join(live, "rid").select(*DEALT).repartition(parts, "list", "chunk").sortWithinPartitions("list", "chunk", F.col("own") != F.col("chunk"))
        # few links of many tasks: as many files as their bytes need, not one for each task
        return materialise(tasks.mapInArrow(link_lists(percent), "src long, dst long").hint("rebalance"), tag)

    longest = mine.withColumn("nth", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("df"), "list"))).where(F.col("nth") <= FIRST)
    first = longest.withColumn("chunks", chunks).withColumn("own", own).select("rid", "list", "own", F.col("own").alias("chunk"), F.col("rid").alias("component"), F.lit(False).alias("minor"), F.lit(None).cast("array<long>").alias("lists"))
    edges = linked(first, "first")

    known = connected_components(edges)
    named = mine.join(known.withColumnRenamed("id", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    several = named.groupBy("list").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("list")
    named = materialise(named.join(several, "list", "left_semi"), "several")
    size = named.groupBy("list", "component").agg(F.count("*").alias("size"))
    main = size.groupBy("list").agg(F.max(F.struct("size", "component")).alias("main")).select("list", F.col("main.component").alias("main"))
    rows = named.join(main, "list").withColumn("minor", F.col("component") != F.col("main")).withColumn("chunks", chunks).withColumn("own", own)
    visits = F.when(F.col("minor") & (F.col("chunks") > 1), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own"))
    lists = mine.join(named.select("rid").distinct(), "rid", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_list("list")).alias("lists"))
    more = linked(rows.withColumn("chunk", F.explode(visits)).select("rid", "list", "own", "chunk", "component", "minor").join(lists, "rid"), "links")
    return edges.unionByName(more)


def product(sets: list[np.ndarray], wide: int = 8192) -> np.ndarray:
    """Sizes of all intersections, from 0/1 matrices a slab of columns at a time."""
    k = len(sets)
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    values = values[n > 1]
    out = np.zeros((k, k), np.float32)
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.searchsorted(values, flat)
    hit = at < len(values)
    hit[hit] = values[at[hit]] == flat[hit]
    row, at = row[hit], at[hit]
    for low in range(0, len(values), wide):
        m = np.zeros((k, min(wide, len(values) - low)), np.float32)
        here = (at >= low) & (at < low + wide)
        m[row[here], at[here] - low] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    component_id is the smallest doc_id that links reach; kept says that this row represents its class (one
    row of each, also among rows that repeat a doc_id). Null and empty texts have no shingles, link with
    nothing and are classes of their own; a null doc_id is never the smallest and stays null only where a
    class has no other. Texts of any length count whole; ties in the order of shingles are broken by their
    hashes; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    buckets, most = parts_for(docs, block_bytes(docs, 12 << 20)), max(BLOCK_WORDS, block_bytes(docs, 1) // 8)
    sent = need(docs, "doc_id", "text").mapInArrow(sketch(words, buckets, most), "bucket int, block long, light binary, light_doc binary, heavy binary, heavy_n binary, docs array<long>, sizes binary, marks binary, lists binary")
    counted = sent.groupBy("bucket").applyInArrow(count_documents, "block long, light binary, light_doc binary, light_df binary, heavy binary, heavy_n binary, heavy_df binary, docs array<long>, sizes binary, marks binary, lists binary, bucket int")
    rows = materialise(counted.groupBy("block").applyInArrow(prefixes(percent), "rid long, doc_id long, n long, mark0 long, mark1 long, matches int, spare int, prefix array<long>, shared binary"), "prefixes")

    same = ["n", "mark0", "mark1"]
    lone = F.when(F.col("n") == 0, F.col("rid"))  # without shingles: a class of its own
    # of rows with the same least doc_id, any one stands for the class
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    classes = materialise(rows.groupBy(*same, lone.alias("lone")).agg(F.min("rid").alias("rid"), first.alias("first")).select(*same, "lone", "rid", F.col("first.doc_id").alias("least"), F.col("first.rid").alias("least_rid")), "classes")
    live = rows.where("prefix IS NOT NULL").join(classes.select("rid"), "rid", "left_semi").select("rid", "n", "matches", "spare", "prefix", "shared")
    linked = connected_components(candidate_links(materialise(live, "candidates"), percent, buckets))

    least = linked.withColumnRenamed("id", "rid").join(classes, "rid").groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("least_rid"))).alias("m"))
    best = linked.join(least, "component").select(F.col("id").alias("rid"), F.col("m.least").alias("top"), F.col("m.least_rid").alias("top_rid"))
    named = classes.join(best, "rid", "left").select(
        *[F.col(c).alias(f"c_{c}") for c in same], F.col("lone").alias("c_lone"),
        F.when(F.col("top_rid").isNull(), F.col("least")).otherwise(F.col("top")).alias("component_id"), F.coalesce("top_rid", "least_rid").alias("kept_rid"),
    )
    match = (F.col("n") == F.col("c_n")) & (F.col("mark0") == F.col("c_mark0")) & (F.col("mark1") == F.col("c_mark1")) & F.coalesce(lone, F.lit(-1)).eqNullSafe(F.coalesce("c_lone", F.lit(-1)))
    return rows.select("rid", "doc_id", *same).join(named, match).select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("rid") == F.col("kept_rid")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, of which one is left of each class of jaccard_classes(): that
    of the smallest doc_id (null last). Rows without words all stay. Columns may have any names. Rows are known
    by a hash of doc_id and text, so docs may be read twice in any order."""
    key, nth = free_name(docs, "key"), free_name(docs, "nth")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    held = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    classes = jaccard_classes(keyed.where(held).select(F.col(key).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias(key), "component_id").distinct()
    ids = classes.join(keyed.where(held).select(key, "doc_id").distinct(), key)
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))).alias("first"))
    left = keyed.where(held).join(first.select(F.col("first.key").alias(key)), key, "left_semi")
    left = left.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(nth) == 1)  # of rows that repeat
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return left.select(*columns).unionByName(keyed.where(~held).select(*columns))
