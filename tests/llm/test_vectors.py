"""Operators on vectors, held against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import near_vectors, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[:60] = x[0] + rng.normal(size=(60, 16)).astype(np.float32) * 0.12
    x[60:90] = x[60]
    x[90:95] = x[60] * 3
    out = [(int(i), [float(v) for v in r], 0) for i, r in enumerate(x)]
    out += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, None), (1003, [float("nan")] * 16, 1), (1004, [None, 1.0], 1), (1005, [float("inf")] * 16, 1), (1006, [1e30] * 16, 1), (1007, [1e-30] * 16, 1), (1008, [1.0, 2.0], 1), (5, out[5][1], 9)]
    return out


def brute(rows, least=0.95):
    good = [r for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    m = np.zeros((len(good), 16))
    for i, r in enumerate(good):
        m[i, : len(r[1])] = np.array(r[1], np.float32)
    m /= np.abs(m).max(1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= least
    np.fill_diagonal(link, False)
    comp = np.arange(len(good))
    while True:
        new = np.array([min(comp[i], comp[link[i]].min(initial=len(good))) for i in range(len(good))])
        if (new == comp).all():
            break
        comp = new
    low = {c: min(good[i][0] for i in np.flatnonzero(comp == c)) for c in set(comp.tolist())}
    return good, link.sum(1), [low[c] for c in comp.tolist()]


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_duplicates(spark, rows, monkeypatch, chunk):
    monkeypatch.setattr(near_vectors, "CHUNK", chunk)
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    good, links, comp = brute(rows)
    want = sorted((r[0], int(n), c) for r, n, c in zip(good, links, comp))
    have = sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id < 1000 or r.vec_id > 1005)
    found = sum(h[1] for h in have) / sum(w[1] for w in want)
    assert 0.99 <= found <= 1
    assert sum(h == w for h, w in zip(have, want)) >= 0.97 * len(want)
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if 1000 <= r.vec_id <= 1005)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_search(spark, rows):
    got = nearest.search(spark.createDataFrame(rows, SCHEMA)).collect()
    good = [r for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    m = np.zeros((len(good), 16))
    for i, r in enumerate(good):
        m[i, : len(r[1])] = np.array(r[1], np.float32)
    ids = np.array([r[0] for r in good])
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i in range(len(good)) if ids[i] % 20 == 0]
    assert set(by) == {int(ids[i]) for i in asked}
    hit = 0
    for i in asked:
        s = m @ m[i]
        s[i] = -np.inf
        want = {int(ids[j]) for j in np.lexsort((ids, -s))[:20]}
        have = sorted(by[int(ids[i])])
        assert [x[0] for x in have] == list(range(1, 21))
        assert [(-x[2], x[1]) for x in have] == sorted((-x[2], x[1]) for x in have)
        hit += len(want & {x[1] for x in have})
    assert hit >= 0.9 * 20 * len(asked)


@pytest.mark.parametrize("n, width", [(3000, 256), (6000, 64)])
def test_recall_as_in_production(spark, n, width):
    x = np.random.default_rng(8).normal(size=(n, width)).astype(np.float32).astype(np.float64)
    got = nearest.search(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(0, n, 20)] = -np.inf
    want = {(20 * q, int(i)) for q, row in enumerate(s) for i in np.argsort(-row)[:20]}
    assert len(found & want) >= 0.95 * len(want)


def test_ties_rank_by_vec_id(spark):
    rows = [(i, [1.0, float(i % 3), 0.0], 0) for i in range(90)]
    got = nearest.search(spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "block": F.lit(2), "rid": F.lit(3)})).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {1.0}
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "rid": F.lit(2), "cell": F.lit(3)})
    assert {(r.vec_id, r.component_id) for r in near_vectors.near_duplicates(clash).collect()} == {(i, i % 3) for i in range(90)}


def test_search_finds_the_smallest_ids_of_many_copies(spark):
    x = np.random.default_rng(5).normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0]  # more copies than are reranked
    got = nearest.search(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)).where("vec_id % 3 = 0 AND query_id % 3 = 0").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == set(range(0, 3000, 60))
    assert all(sorted(v) == [i for i in range(0, 66, 3) if i != k][:20] for k, v in by.items())


def test_few_and_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_vectors.near_duplicates(empty).collect() == []
    assert nearest.search(empty).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, [0.0, 1.0], 0)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest.search(few).orderBy("rank").collect()] == [(0, 1, 1, 2.0), (0, 2, 2, 0.0)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_duplicates(few).collect()) == [(0, 1, 0), (1, 1, 0), (2, 0, 2)]


def test_traversal_is_by_distance():
    rng = np.random.default_rng(1)
    index = near_vectors.MultiIndex(rng.normal(size=(200, 8)), 6)
    one, two = rng.random(6), rng.random(6)
    seen = list(index.traverse(one, two, 0.9))
    assert [d for d, _ in seen] == sorted(d for d, _ in seen)
    assert {c for _, c in seen} == {i * 6 + j for i in range(6) for j in range(6) if one[i] + two[j] <= 0.9}


def test_codes_come_closer_with_more_books():
    x = np.random.default_rng(2).normal(size=(500, 16))
    errors = []
    for books in (1, 2, 4):
        q = nearest.AdditiveQuantiser(x, books, 16)
        codes, norms = q.encode(x)
        coded = sum(q.books[m][codes[:, m]] for m in range(books))
        assert norms == pytest.approx((coded * coded).sum(1), rel=1e-3)
        errors.append(((x - coded) ** 2).mean())
    assert errors == sorted(errors, reverse=True)
