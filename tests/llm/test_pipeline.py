"""The pipeline's stages against brute force, each on what the one before it left."""

import collections
import zlib

import duckdb
import numpy as np
import pytest
from test_texts import WORD, brute_classes, brute_cuts, library

import corpus_pipeline
from fathom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).cache()
        out.append([tuple(r) for r in docs.collect()])
    return out


def test_stages(spark, stages):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    clean, one, cut, packed = stages
    assert set(clean) <= set(docs) and len(clean) >= 0.8 * len(docs)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(r[0]) == 0 for r in clean) == sum(labels.get(r[0]) == 0 for r in docs)
    keep = {c for _, _, c in brute_classes(clean)[0]}
    assert {r[0] for r in one} == keep and set(one) <= set(clean)
    rows = {r[0]: r for r in cut}
    assert len(cut) == len(one)
    for r, gone in zip(one, brute_cuts([(r[1] or "").encode() for r in one])):
        text = np.frombuffer((r[1] or "").encode(), np.uint8)[~gone].tobytes().decode(errors="ignore")
        assert rows[r[0]] == (r[0], text, r[2], r[3], len(text))
    encode, want = library(WORD), []
    for r in cut:
        ids = np.array([*encode(r[1]), 0], np.uint32)
        want += [(r[0], k, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for k, i in enumerate(range(0, len(ids), 2048))]
    assert sorted(p[:5] for p in packed) == sorted(want)


def test_run_gives_the_last_stage(spark, stages):
    got = collections.Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect())
    assert got == collections.Counter(p[:5] for p in stages[-1])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_workers_keep_nothing_of_other_steps(spark):
    import gc
    import weakref

    import public_tokenizers

    from fathom.llm import common, tokens, toxicity

    enc = weakref.ref(tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), "word"))
    assert tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), "word") is enc()
    common.kept("index of a step", list)
    gc.collect()
    assert enc() is None
    common.release()

    rows = [(i, f"a{i % 7} b{i % 5} c") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i, _ in rows], "doc_id long, toxic int")
    toxicity.without_toxic(docs, labels).count()

    def held(batches):
        import pyarrow as pa

        from fathom.llm import common

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._kept)] * b.num_rows, pa.int64())], ["n"])

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
