import datetime as dt


from fathom.operators.rates import rate_statistics, sliding_rates
from fathom.schema import RECORD
from fathom.sources.adapters import lineitem_records
from fathom.streaming.rates import ingest, owner_totals, record_stream, sliding_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(seconds=s),) for s in (0, 0, 1, 5, 9, 10, 30, 31)] + [(at + dt.timedelta(hours=1),)]
    df = spark.createDataFrame(rows, "ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = sliding_stream(spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    got = {int(r.window_end.replace(tzinfo=dt.timezone.utc).timestamp()): r.in_window for r in spark.table("rates").collect()}
    batch = {r.pane: r.in_window for r in sliding_rates(df, 1, 10).collect()}
    for pane, n in batch.items():
        if pane + 1 in got:
            assert got[pane + 1] == n
    assert len([p for p in batch if p + 1 in got]) == len(batch) - 1  # the last window is still open
    assert rate_statistics(sliding_rates(df, 1, 10)).first().events == 9


def test_ingest_arriving_records(spark, tmp_path):
    records = lineitem_records(spark, SF).selectExpr(*[f.name if f.name in ("path", "type", "uid", "gid", "size", "inode", "dev_major", "dev_minor", "nlink", "atime", "mtime", "ctime") else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in RECORD])
    records.write.parquet(str(tmp_path / "in"))
    ingest(record_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), 8).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == records.count()
    q = owner_totals(record_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("owners").start()
    q.processAllAvailable()
    q.stop()
    want = records.where("type = 'f'").count()
    assert sum(r.files for r in spark.table("owners").collect()) == want
