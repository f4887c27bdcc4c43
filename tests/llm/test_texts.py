"""Operators on texts, held against brute force over rows of all kinds, and on an empty table."""

import base64
import collections
import hashlib
import inspect
import math
import random
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from fathom.llm import byte_bpe, jaccard, licences, lm, packing, repair_store, suffix, tokens, toxicity
from fathom.llm.common import connected_components, hoard, pack, unpack
from fathom.llm.tokens import CachedEncoder

BYTE, WORD, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def library(path):
    t = Tokenizer.from_file(path)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def words(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


# ------------------------------------------------------------ 1


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((r[0], len(sets[i]), low[find(i)]) for i, r in enumerate(rows)), key=repr), len(low)


def test_jaccard_classes(docs, odd_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)  # lists of several chunks
    got = jaccard.jaccard_classes(docs)
    want, classes = brute_classes(odd_rows)
    assert rows_of(got.select("doc_id", "n_shingles", "component_id")) == want
    assert got.where("kept").count() == classes


def test_jaccard_near_the_threshold(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"v{rng.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == brute_classes(rows)[0]


@pytest.mark.parametrize("chunk, first", [(128, 2), (5, 2), (3, 0)])
def test_jaccard_of_pages_from_few_sentences(spark, monkeypatch, chunk, first):
    # most pages share sentences with many others, few are alike; a crowd of near copies that chains link
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "FIRST", first)
    rng = random.Random(12)
    pool = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(12)) for _ in range(40)]
    pages = [[rng.choice(pool) for _ in range(12)] for _ in range(160)]
    for i in range(60):
        p = list(pages[i % 7]) if i % 2 else list(pages[-1])
        p[rng.randrange(12)] = rng.choice(pool)
        pages.append(p)
    rows = [(i, " ".join(p)) for i, p in enumerate(pages)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == brute_classes(rows)[0]


def test_heavy_shingles_travel_as_counts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 3)
    rows = [(i, "one two three four five six seven eight nine ten " + ("x" * (i % 3))) for i in range(40)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == brute_classes(rows)[0]


def test_links_lie_in_few_files(spark, monkeypatch):
    files, write = {}, jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, tag: files.setdefault(tag, write(df, tag)))
    pages = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    rows = [(i, page) for i, page in enumerate(pages)] + [(i + 40, f"{page} more") for i, page in enumerate(pages)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == brute_classes(rows)[0]
    assert files["first"].count() >= 40 and len(files["first"].inputFiles()) == 1


def test_one_of_each_keeps_whole_rows(docs, odd_rows):
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    assert left.count() == brute_classes(odd_rows)[1]


def test_more_matches_for_dearer_prefixes():
    assert jaccard.pick_matches(np.array([2, 2, 2]), 1, 10) == 1
    assert jaccard.pick_matches(np.full(60, 901), 50, 2000) > 1


# ------------------------------------------------------------ 2


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] * rng.randint(1, 2)
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_cuts(texts, length=200):
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        yield np.cumsum(gone)[:-1] > 0


def test_removed_bytes(spark, docs, odd_rows):
    rng = random.Random(8)
    passage = "".join(rng.choice("abc déf.\n") for _ in range(900))
    more = [(1000 + i, "".join(rng.choice("klmno") for _ in range(rng.randint(0, 150))) + passage[rng.randint(0, 300) : rng.randint(400, 900)] + "".join(rng.choice("pqrst") for _ in range(50)), "en", "s", 1) for i in range(25)]
    more += [(2000 + i, passage[i : i + 199 + i % 3], None, None, None) for i in range(0, 60, 7)]
    rows = odd_rows + more
    want = []
    for r, gone in zip(rows, brute_cuts([(r[1] or "").encode() for r in rows])):
        b = np.frombuffer((r[1] or "").encode(), np.uint8)
        want.append((r[0], len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(b[~gone].tobytes()).hexdigest()))
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert rows_of(got) == sorted(want, key=repr)


def test_cut_texts_keep_their_rows(docs, odd_rows):
    got = suffix.without_repeats(docs)
    assert got.columns == docs.columns
    want = []
    for r, gone in zip(odd_rows, brute_cuts([(r[1] or "").encode() for r in odd_rows])):
        b = np.frombuffer((r[1] or "").encode(), np.uint8)
        want.append((r[0], None if r[1] is None else b[~gone].tobytes().decode(errors="ignore")))
    assert rows_of(got.select("doc_id", "text")) == sorted(want, key=repr)


# ------------------------------------------------------------ 3


def brute_licence(text):
    low = (text or "").translate(str.maketrans(licences.UPPER, licences.LOWER))
    import re

    norm = lambda s: re.sub(licences.WORD_GAP, " ", s).strip(" ")
    pairs = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:])]
    dice = lambda g, t: 2.0 * len(set(g) & set(t)) / (len(set(g)) + len(t))
    row, found = pairs(norm(low).split(" ")), []
    templates = {n: licences.bigrams(t) for n, t in licences.TEMPLATES.items()}
    windows = {(n, i - at) for n, t in licences.TEMPLATES.items() for g, at in licences.anchors(t, 0.8) for i, x in enumerate(row) if x == g}
    for n, start in windows:
        found.append((-dice(row[max(start, 0) : start + len(licences.words_of(licences.TEMPLATES[n])) - 1], templates[n]), n))
    for u in {norm(x) for x in [low, *low.split("\n"), *re.split(licences.SENTENCE, low)]} if windows else ():
        if g := pairs(u.split(" ")):
            found.append(min((-dice(g, t), n) for n, t in templates.items()))
    hits = [f for f in found if f[0] <= -0.8]
    return (len({n for _, n in hits}), min(hits)[1], -min(hits)[0]) if hits else (0, None, None)


def wrapped(text, width, mark):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_licences(spark, docs, odd_rows):
    t = licences.TEMPLATES
    texts = [*t.values(), "Intro. " + t["MIT"] + " More prose follows here.\nAnd more.", "Licensed under the Apache Licence, Version 2.0.", t["GPL-3.0"].upper() + "\n" + t["CC-BY-NC-4.0"], t["ISC"].replace(" ", "\n"), "the mit license", "Released under the MIT License. Released under the MIT License"]
    texts += [t["MIT-grant"][:-40], "x " * 30 + t["ISC-text"][60:] + " y" * 30, "license " * 3000]
    rows = [(i, x) for i, x in enumerate(texts)] + [r[:2] for r in odd_rows]
    want = sorted(((i, *brute_licence(x)) for i, x in rows), key=repr)
    assert rows_of(licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert licences.scan_licences(docs).count() == len(odd_rows)
    assert "Python" not in licences.scan_licences(docs)._jdf.queryExecution().executedPlan().toString()


def test_wrapped_notices_inside_long_files(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice("def return value self import the of with open file".split()) for _ in range(150))
    names, rows = sorted(licences.TEMPLATES), []
    for i, n in enumerate(names):
        for k, (width, mark) in enumerate(((70, ""), (76, "# "), (40, " * "), (60, "// "))):
            rows.append((i * 10 + k, prose() + "\n\n" + wrapped(licences.TEMPLATES[n], width, mark) + "\n\n" + prose()))
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.dice == 1.0 and r.n_matches >= 1 for r in got.values())
    assert {names[k // 10] for k, r in got.items() if r.licence != names[k // 10]} <= {n for n in names if any(m != n and set(licences.bigrams(licences.TEMPLATES[m])) <= set(licences.bigrams(licences.TEMPLATES[n])) for m in names)}


def test_notices_without_any_anchor(spark):
    pairs = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:])]
    signs = {g for t in licences.TEMPLATES.values() for g, _ in licences.anchors(t, 0.8)}
    rows, want = [], []
    for i, (name, text) in enumerate(sorted(licences.TEMPLATES.items())):
        grams, words = set(licences.bigrams(text)), licences.words_of(text)
        while signs & set(pairs(words)):
            k = next(k for k, g in enumerate(pairs(words)) if g in signs)
            # of two words that one change would rid of an anchor, the one that rids it of more
            words[max(k, k + 1, key=lambda j: sum(g in signs for g in pairs(words[max(j - 1, 0) : j + 2])))] = f"zq{k}"
        left = pairs(words)
        dice = 2.0 * len(grams & set(left)) / (len(grams) + len(set(left)))
        if dice >= 0.8:
            rows += [(2 * i, " ".join(words)), (2 * i + 1, "open file " * 90 + "\n" + wrapped(" ".join(words), 70, "# ") + "\n" + " close file" * 90)]
            want += [(2 * i, name, dice), (2 * i + 1, name, dice)]
    assert want  # as of Zlib
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [k for k, *_ in want]
    assert all(r.n_matches >= 1 and r.dice >= dice for r, (_, _, dice) in zip(got, want))


def test_marks_stand_in_every_match():
    for text in licences.TEMPLATES.values():
        grams, marks = licences.bigrams(text), set(licences.marks_of(text, 0.8))
        assert sum(bool(marks & set(g.split())) for g in grams) > licences.bounds(len(grams), 0.8)[2]


# ------------------------------------------------------------ 5


class BruteModel:
    """The smoothed probabilities from counts of all n-grams, by their definition."""

    def __init__(self, train, order=lm.ORDER, prior=lm.PRIOR):
        self.order, self.prior, self.counts = order, prior, collections.Counter()
        for w in train:
            seq = ["\x02", *w, "\x03"]
            self.counts[seq[0],] += 1
            for i in range(1, len(seq)):
                for k in range(1, min(order, i + 1) + 1):
                    self.counts[tuple(seq[i - k + 1 : i + 1])] += 1
        ones = [c for g, c in self.counts.items() if len(g) == 1 and g != ("\x02",)]
        self.n, self.v = sum(ones), len(ones)

    def p(self, state, token):
        if not state:
            return (self.counts.get((token,), 0) + 1) / (self.n + self.v + 1)
        return (self.counts.get((*state, token), 0) + self.prior * self.p(state[1:], token)) / (self.counts.get(state, 0) + self.prior)

    def score(self, w):
        seq = ["\x02", *w, "\x03"]
        return sum(math.log10(self.p(tuple(seq[max(0, i - self.order + 1) : i]), seq[i])) for i in range(1, len(seq)))


@pytest.mark.parametrize("order, block", [(3, 9 << 20), (3, 5000), (1, 5000), (4, 5000)])
def test_language_model(docs, odd_rows, monkeypatch, order, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)  # a text of 200,000 bytes and many blocks
    got = rows_of(lm.score_texts(docs, order))
    fold = lambda r: zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7
    a, want = BruteModel([words(r[1]) for r in odd_rows if fold(r) != 2], order), []
    for r in odd_rows:
        w = words(r[1])
        c = [a.counts.get((x,), 0) for x in [*w, "\x03"]]
        want.append((r[0], fold(r) == 2, len(c), sum(x > 0 for x in c), a.n, sum(math.log10((x + 1) / (a.n + a.v + 1)) for x in c), a.score(w)))
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    for x, y in zip(sorted(got, key=key), sorted(want, key=key)):
        assert x[:5] == y[:5]
        assert x[5:] == pytest.approx(y[5:], rel=1e-11, abs=1e-9)


def test_scores_come_from_the_automaton():
    learnt, asked = ["a", "b", "a"], ["a", "c"]
    seqs, first, ends = [["\x02", *t, "\x03"] for t in (learnt, asked)], [0, 4], [4, 7]
    events = [tuple(s[: i + 1]) for s in seqs for i in range(1, len(s))]
    brute, numbers, counts = BruteModel([learnt]), [], []
    for k in (1, 2, 3):
        grams = sorted({e[-k:] for e in events if len(e) >= max(k, 2)})
        numbers.append(np.array([grams.index(e[-k:]) if len(e) >= max(k, 2) else -1 for e in events]))
        counts.append(np.array([brute.counts.get(g, 0) for g in grams]))
    a = lm.BackoffAutomaton(numbers, counts, np.array(first), 1, brute.n, brute.v, lm.PRIOR)
    assert [a.score(x, y) for x, y in zip(first, ends)] == pytest.approx([brute.score(learnt), brute.score(asked)])
    # states: nothing, a text's start, end, a, b, "start a", "a end", "a b", "b a"; a failure arc forgets one token
    assert list(a.fail_to) == [0, 0, 0, 0, 0, 3, 2, 4, 3]
    assert a.loss[0] == 0 and all(x < 0 for x in a.loss[1:])
    assert "automaton.score(" in inspect.getsource(lm.run_automaton)  # what the query calls


def test_probabilities_add_up():
    a = BruteModel([["a", "b", "a"], ["b", "b", "c"]])
    for state in ((), ("a",), ("a", "b"), ("\x02",), ("c",)):
        assert sum(a.p(state, w) for w in ("a", "b", "c", "\x03", "unknown")) == pytest.approx(1)


# ------------------------------------------------------------ 6


def labelled(rng, n):
    bad = ["vile", "foul", "nasty"]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        w = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 60))]
        if y:
            w[rng.randrange(len(w))] = rng.choice(bad).upper() + "!"
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_finds_held_out_rows(spark, docs, odd_rows):
    rows = labelled(random.Random(4), 900)
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    y = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, y).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {r[0] for r in held} == {k for k, v in got.items() if v.held_out}
    assert sum(got[r[0]].predicted == r[2] for r in held) >= 0.98 * len(held)
    assert all(0 <= v.score <= 1 for v in got.values())
    assert any(e.toxic for v in got.values() for e in v.evidence)
    model = toxicity.fit(d, y)
    assert toxicity.score_toxicity(docs, y, model=model).count() == len(odd_rows)
    kept = toxicity.without_toxic(d.withColumn("more", d.doc_id), y)
    assert kept.columns == ["doc_id", "text", "more"]
    assert {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if not v.predicted}


def test_toxicity_keeps_terms_of_clean_text_too(spark):
    # of label 1: a tenth of all, two fifths of those with "mild", none of those with "calm"
    rows = [(i, f"mild word{i % 7}" if i < 200 else f"calm word{i % 7}" if i < 600 else f"word{i % 7}", int(i < 80 or i >= 680)) for i in range(700)]
    d, y = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    assert {"mild", "calm"} <= {str(t) for t in model.terms}
    got = {r.text: r for r in toxicity.score_toxicity(d, y, model=model).join(d, "doc_id").where("held_out").collect()}
    assert all(got[f"{w} word{k}"].evidence for w in ("mild", "calm") for k in range(7))
    assert min(got[f"mild word{k}"].score for k in range(7)) > max(got[f"calm word{k}"].score for k in range(7))


def test_toxicity_learns_from_few_labels(spark):
    # of forty examples three hold "scum" and three "moron", all toxic; a held-out row holds one of them
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:40]
    held = next(i for i in range(3000, 3100) if zlib.crc32(str(i).encode()) % 5 == 0)
    rows = [(i, f"a{i % 5} b{i % 3}" + (" scum" if k < 3 else " moron" if k < 6 else ""), int(k < 6)) for k, i in enumerate(learn)] + [(held, "a1 b2 scum", 1), (held + 1, "a1 b2", 0), (held + 2, "unknown", 0)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    y = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 3000], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(d, y).collect()}
    assert [got[held + i] for i in range(3)] == [1, 0, 0]
    assert held not in {r.doc_id for r in toxicity.without_toxic(d, y).collect()}


@pytest.mark.parametrize("dense", [1 / 32, 2.0])
def test_block_max_search_is_exact(monkeypatch, dense):
    monkeypatch.setattr(toxicity, "DENSE", dense)  # some terms as rows of weights; all as lists
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.01
        vectors.append((t, w / np.linalg.norm(w)))
    vectors += vectors[:20]
    index = toxicity.BlockMaxIndex(vectors, 40, 16)
    m = np.zeros((len(vectors), 40))
    for i, (t, w) in enumerate(vectors):
        m[i, t] = w
    got = index.nearest(vectors, 7, [[i] if i % 2 else [i, (i + 1) % 720] for i in range(720)])
    for i in range(720):
        s = m @ m[i]
        want = sorted((-round(x, 9), j) for j, x in enumerate(s) if x > 0 and j != i and (i % 2 or j != (i + 1) % 720))[:7]
        assert [(-round(x, 9), j) for x, j in got[i]] == want


def brute_scores(rows, labels):
    """Scores by the definition: every example against every text, nothing left out but a row's own."""
    terms = lambda t: collections.Counter(x for w in words(t) if (x := w.lower().strip(toxicity.EDGES)))
    bags, df = [terms(t) for _, t in rows], collections.Counter()
    for b in bags:
        df.update(set(b))
    learn = [(d, b, labels[d]) for (d, _), b in zip(rows, bags) if labels.get(d) is not None and zlib.crc32(str(d).encode()) % 5]
    n, positive = len(learn), sum(y for *_, y in learn)
    seen = [collections.Counter(t for _, b, y in learn if y == z for t in b) for z in (0, 1)]
    known = sorted(set(seen[0]) | set(seen[1]))
    evidence = toxicity.evidence_of(*(np.array([seen[z][t] for t in known], float) for z in (1, 0)), n, positive)
    weight = {t: (math.log((len(rows) + 1) / (df[t] + 1)) + 1) * math.sqrt(1 + e) for t, e in zip(known, evidence)}

    def unit(b):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in b.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples, empty = sorted((d, unit(b), y) for d, b, y in learn if b), [y for _, b, y in learn if not b]
    prior = (sum(empty) + positive / n) / (len(empty) + 1)

    def vote(v, own):
        near = sorted((-sum(x * e.get(t, 0) for t, x in v.items()), i) for i, (d, e, _) in enumerate(examples) if d != own)
        near = [(-s, i) for s, i in near if s < 0][: toxicity.NEIGHBOURS]
        return (sum(s * s * examples[i][2] for s, i in near) + 0.1 * prior) / (sum(s * s for s, _ in near) + 0.1)

    model = toxicity.Scorer(None, None, None, np.array([y for *_, y in examples]), prior, None)
    model.calibrate(np.array([vote(e, d) for d, e, _ in examples]))
    return [model.calibrated(vote(v, d)) if (v := unit(b)) else prior for (d, _), b in zip(rows, bags)]


def test_an_index_is_made_in_little_more_memory_than_it_takes():
    import tracemalloc

    rng, size = np.random.default_rng(3), 400
    terms = pa.array([f"t{i:05}" for i in range(25_600)], pa.large_string())
    held = np.arange(1, 4001) * size, np.concatenate([np.sort(rng.choice(25_600, size, replace=False)) for _ in range(4000)]).astype(np.int32), np.ones(4000 * size, np.int32)
    model = toxicity.Scorer(terms, np.ones(25_600), np.arange(4000), np.zeros(4000, np.int64), 0.1, held)
    tracemalloc.start()
    index = toxicity.BlockMaxIndex.of(model)
    takes, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < takes + 25 * len(index.place)  # bytes
    assert len(index.place) == 4000 * size and index.nearest([model.vector(7, held)], 1)[0][0][1] == 7


def test_toxicity_equals_brute_force(spark, odd_rows):
    rows, labels = [r[:2] for r in odd_rows if r[0] is not None], {}
    rows = list({r[0]: r for r in rows}.values()) + [(5000 + i, t) for i, t, _ in labelled(random.Random(6), 300)]
    labels = {d: y for (d, _), (_, _, y) in zip(rows[-300:], labelled(random.Random(6), 300))} | {r[0]: 0 for r in rows[:20]} | {rows[21][0]: None}
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    have = {r.doc_id: r.score for r in got.collect()}
    assert [have[d] for d, _ in rows] == pytest.approx(brute_scores(rows, labels), abs=1e-9)
    assert all(e.doc_id != r.doc_id for r in got.collect() for e in r.evidence)  # no row is its own neighbour


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}


# ------------------------------------------------------------ 7


def test_re_pair_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(100):
        sizes = rng.integers(0, 40, rng.integers(0, 8))
        ids = rng.integers(0, rng.integers(1, 5) + 1, sizes.sum()).astype(np.uint32)
        shard = repair_store.Shard(repair_store.to_shard(ids, sizes))
        assert b"".join(shard.documents()) == ids.tobytes()
        ends, pairs = np.cumsum(sizes), collections.Counter()
        for i, n in enumerate(sizes):
            own = ids[ends[i] - n : ends[i]]
            assert (shard.document(i) == own).all()
            a, b = sorted(rng.integers(0, n + 2, 2))
            assert (shard.span(i, a, b) == own[a:b]).all()
            s, k = shard.seq[shard.starts[i] : shard.starts[i + 1]].tolist(), 0
            while k < len(s) - 1:
                pairs[s[k], s[k + 1]] += 1
                k += 2 if s[k : k + 3] == [s[k]] * 3 else 1
        assert max(pairs.values(), default=0) < 2  # Re-Pair's own end


def test_re_pair_at_the_size_of_a_shard():
    rng = np.random.default_rng(1)
    for kinds in (3, 15, 60_000):
        sizes = rng.integers(0, 4000, 12)
        sizes[3] = 300_000  # more than a shard's ids
        ids = rng.integers(0, kinds, sizes.sum()).astype(np.uint32)
        shard, ends = repair_store.Shard(repair_store.to_shard(ids, sizes)), np.cumsum(sizes)
        assert b"".join(shard.documents()) == ids.tobytes()
        assert (shard.span(3, 123_456, 234_567) == ids[ends[2] + 123_456 : ends[2] + 234_567]).all()


@pytest.mark.parametrize("bits", [17, 32])
def test_re_pair_ranks(bits):
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 1 << (2 * bits), 5000, dtype=np.uint64))
    size = rng.integers(2, 40, len(pairs)).astype(np.uint64)
    rank = repair_store.ranks(pairs, size, bits)
    assert len(np.unique(rank)) == len(pairs) and rank.max() < repair_store.NO_RANK
    assert (np.diff(size[np.argsort(rank)].astype(int)) <= 0).all()


def test_re_pair_reads_only_what_may_change(monkeypatch):
    rng = np.random.default_rng(4)
    ids = np.concatenate([np.arange(100_000), rng.integers(100_000, 100_020, 4000)]).astype(np.uint32)
    read, ordered = [], repair_store.ordered
    monkeypatch.setattr(repair_store, "ordered", lambda seq, at, *more: read.append(len(at)) or ordered(seq, at, *more))
    shard = repair_store.Shard(repair_store.to_shard(ids, np.array([len(ids)])))
    assert (shard.document(0) == ids).all()
    assert len(read) > 3 and sum(read[1:]) < 8000  # what occurs once is read by the first pass alone


def test_shards_are_made_in_memory_that_is_there():
    import resource

    rng = np.random.default_rng(5)
    ids, sizes = rng.zipf(1.2, repair_store.SHARD_IDS).clip(max=50_000).astype(np.uint32), np.full(256, repair_store.SHARD_IDS // 256)
    hoard()
    for _ in range(2):
        repair_store.to_shard(ids, sizes)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    repair_store.to_shard(ids, sizes)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 500  # pages; some 6000 without


@pytest.mark.parametrize("bits", [1, 7, 8, 17, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 8, 1001])
def test_bits(bits, n):
    values = np.random.default_rng(6).integers(0, 1 << bits, n).astype(np.uint32)
    data = repair_store.to_bits(values, bits)
    assert data == np.packbits(np.array([int(c) for v in values for c in f"{v:0{bits}b}"], np.uint8)).tobytes()
    got, end = repair_store.from_bits(b"head" + data + b"tail", n, bits, 4)
    assert end == 4 + len(data) and (got == values).all()


def test_re_pair_compresses():
    ids = np.tile(np.arange(50, dtype=np.uint32), 200)
    assert len(repair_store.to_shard(ids, np.array([5000, 5000]))) < len(ids)


def test_token_id_files(docs, odd_rows):
    encode = library(BYTE)
    got = repair_store.read_digest(repair_store.write_ids(docs, BYTE, shard_ids=3000)).collect()
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted((r[0] for r in odd_rows), key=lambda x: (x is not None, x or 0))
    at = 0
    want = collections.defaultdict(list)
    for r in odd_rows:
        ids = np.array([*encode(r[1]), 2], np.uint32)
        want[r[0]].append((len(ids), zlib.crc32(ids.tobytes())))
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))


@pytest.mark.parametrize("path, kind", [(BYTE, "byte"), (WORD, "word")])
def test_pieces_encode_like_whole_texts(path, kind, odd_rows):
    encode, own = library(path), CachedEncoder(path, kind)
    more = ["a\t b", "a \tb c", "a\n b", "a \nb", "\n", "\na", "a\n", "x\n\n\ny z", "\x1c a\x1cb c\x1d", "Foo!! BAR,. x.,", "naïve ÉCOLE ſtraße ĲSSEL ǅ ŉ İx", "a:b,c ª º µ", "<|endoftext|> a", "it's we'll  ", "日本語 テキスト。\n", "é é"]
    for t in [r[1] for r in odd_rows] + more:
        assert np.frombuffer(own.encode_one(t), np.uint32).tolist() == encode(t), t


@pytest.mark.parametrize("group", [1, 3000, 8 << 20])
@pytest.mark.parametrize("path, kind", [(BYTE, "byte"), (WORD, "word")])
def test_texts_encoded_in_groups(path, kind, group, odd_rows, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_BYTES", group)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 100)
    rng, encode, own, met = random.Random(9), library(path), CachedEncoder(path, kind), []
    odd = ["\n\n", " lead", "trail ", "a  b", "x\ty\n", "\n", " ", "Tab\t", "<|endoftext|> z", "[UNK]", "\xa0q\xa0", "é! \u3000", "wort. Wort, WORT", "İstanbul ǅ. ɐ!"]
    rows = [(i, rng.choice([t[1] for t in odd_rows if len(t[1] or "") < 3000] + odd)) for i in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 7])], ["doc_id", "text"]).slice(i % 2) for i in range(0, 200, 7)]
    fresh = own.fresh
    own.fresh = lambda piece: met.append(piece) or fresh(piece)
    got = [(doc, np.frombuffer(ids, np.uint32).tolist()) for docs, texts in own.encode_rows(iter(batches)) for doc, ids in zip(docs, texts)]
    assert got == [(doc, encode(t)) for i, (doc, t) in enumerate(rows) if not (i % 7 == 0 and i % 2)]
    if group == 8 << 20:
        assert len(met) == len(set(met)) > 100  # a group's pieces are encoded once, even if the dictionaries are small
        met.clear()
        own.encode(["zebra  crossing", "gnu \t gnat"])
        assert kind == "word" or not met  # nor what stands in texts alone that are encoded whole


def test_words_are_cut_in_groups_of_two_megabytes():
    text = " ".join(f"w{i % 5000}" for i in range(20_000))
    rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    groups = [len(docs) for docs, _ in CachedEncoder(WORD, "word").encode_rows(iter([rows] * 40))]
    assert sum(groups) == 40 and max(groups) * len(text) < 3 << 20


@pytest.mark.parametrize("path, kind", [(BYTE, "byte"), (WORD, "word")])
def test_signs_after_words(path, kind):
    rng, encode, own, whole = random.Random(8), library(path), CachedEncoder(path, kind), []
    library_whole = own.whole
    own.whole = lambda text: whole.append(text) or library_whole(text)
    signs = ["***", "$$$", ".###", "%%%", ",&&&", "#$%&*"]
    for _ in range(300):
        t = " ".join("".join(rng.choice("abcdéñß") for _ in range(6)) + rng.choice(signs) for _ in range(4))
        assert np.frombuffer(own.encode_one(t), np.uint32).tolist() == encode(t), t
    assert not whole  # runs of signs are kept by themselves, words go to the model


# ------------------------------------------------------------ 8


def test_byte_level_bpe(docs, odd_rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in odd_rows:
        ids = lib.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    assert rows_of(byte_bpe.digest_texts(docs, RANKS, public_tokenizers.PATTERN)) == sorted(want, key=repr)
    full = byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.data) for r in full) == sorted((r[1] or "").encode() for r in odd_rows)


def test_appends_and_edits_are_exact():
    ranks, rng = byte_bpe.codec(RANKS, public_tokenizers.PATTERN).ranks, random.Random(6)
    for _ in range(150):
        s = "".join(rng.choice("abctheinAB ,.é") for _ in range(rng.randint(0, 40))).encode()
        p = byte_bpe.PrefixEncoding(ranks, s[:9])
        p.append(s[9:])
        assert p.ids() == ranks.merge(s, 1 << 40)
        k = rng.randint(0, len(s))
        assert p.ids(k) == ranks.merge(s[:k], 1 << 40)
        cut, new = rng.randint(0, 5), b"the" * rng.randint(0, 2)
        p.edit(k, cut, new)
        assert p.ids() == ranks.merge(s[:k] + new + s[k + cut :], 1 << 40)


# ------------------------------------------------------------ 10


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_rules_are_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(200):
        cap = rng.randint(1, 40)
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 80))]
        bins = collections.defaultdict(list)
        for n, first, last, b, each, at in packing.best_fit_rules(collections.Counter(lengths), cap):
            for k in range(last - first):
                bins[b + k // each].append((at + k % each * n, n))
        assert len(bins) == plain_best_fit(lengths, cap)
        assert sorted(n for v in bins.values() for _, n in v) == sorted(lengths)
        for v in bins.values():
            end = 0
            for at, n in sorted(v):
                assert at == end
                end += n
            assert end <= cap


def test_packing(docs, odd_rows):
    encode = library(WORD)
    got = packing.best_fit_pack(docs, WORD).collect()
    want = []
    for r in odd_rows:
        ids = np.array([*encode(r[1]), 0], np.uint32)
        want += [(r[0], k, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for k, i in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 2048
    assert len(by) == plain_best_fit([w[3] for w in want], 2048)


# ------------------------------------------------------------ all


def test_empty_tables(spark, no_docs):
    assert jaccard.jaccard_classes(no_docs).collect() == []
    assert suffix.remove_repeats(no_docs).collect() == []
    assert licences.scan_licences(no_docs).collect() == []
    assert lm.score_texts(no_docs).collect() == []
    assert toxicity.score_toxicity(no_docs, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []
    assert repair_store.read_digest(repair_store.write_ids(no_docs, BYTE)).collect() == []
    assert byte_bpe.digest_texts(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []
    assert packing.best_fit_pack(no_docs, WORD).collect() == []


def test_components(spark):
    rng = random.Random(3)
    for n, m in ((60, 40), (50, 200), (1, 0)):
        edges = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(m)] + ([(i, i + 1) for i in range(1000, 1040)] if n == 60 else [])
        root: dict = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {x: find(x) for x in root}


def test_packed_integers():
    for seed in range(50):
        rng = np.random.default_rng(seed)
        v = np.sort(rng.integers(0, 2 ** rng.integers(1, 63), rng.integers(0, 50)).astype(np.uint64))
        assert (unpack(pack(v)) == v).all()


def test_small_integers_as_ids(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id int, text string")
    assert rows_of(jaccard.jaccard_classes(d).select("doc_id", "component_id")) == [(1, 1), (2, 1)]
    assert rows_of(suffix.without_repeats(d)) == rows_of(d)
    assert packing.best_fit_pack(d, WORD).count() == lm.score_texts(d).count() == 2
