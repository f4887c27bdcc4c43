"""Every registered query against its SQL in DuckDB, and the goldens of the full heat map."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom.plans.catalogue import ORACLE_SQL, QUERIES
from fathom.sources.adapters import lineitem_records

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert canon(tuple(r) for r in df.select(*cols).collect()) == canon(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_golden_heat_map(spark):
    if not os.path.exists("/root/testdata/sf0.01"):
        pytest.skip("no data")
    got = {(r.age_bucket, r.size_bucket): (r.files, r.bytes, r.led_files, r.led_bytes) for r in QUERIES["heatmap_effective"](spark, "/root/testdata/sf0.01").collect()}
    assert got[0, 0] == (1768, 462918, 1081, 269880)
    assert got[3, 3] == (566, 314790475200, 274, 148248220000)
    assert got[5, 5] == (3015, 176126619650000, 1195, 71476855770000)


def test_round_trip_keeps_all_records(spark):
    want = {r.type: (r.n, r.b) for r in lineitem_records(spark, SF).groupBy("type").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    assert {r.type: (r.n, r.bytes) for r in QUERIES["bin_roundtrip"](spark, SF).collect()} == want


def test_repair_report_covers_all_records(spark):
    d = "/root/testdata/sf0.01"  # owners beyond the first twenty
    rows = QUERIES["repair_report"](spark, d).collect()
    assert sum(r.records for r in rows) == lineitem_records(spark, d).count()
    assert {(r.status, r.sidecar_ok) for r in rows} == {("ok", True)}
