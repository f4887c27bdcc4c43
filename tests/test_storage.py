"""A real tree, shards in the packed format, manifests, reports, search and retention."""

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from fathom import cli
from fathom.operators import heatmap, retention, rollup, summary
from fathom.operators.repair import judge, repair, shard_report, tail_summary, unready
from fathom.operators.search import PathIndex, term_of
from fathom.serve import search_answer
from fathom.sources.layout import of_owner, read_all, write_records
from fathom.sources.manifest import manifest_text, one_layout, owner_names, read_manifests
from fathom.sources.shards import HEADER, MAGIC, OLD_MAGIC, encode, read_shards, read_sidecar, scan, sidecar, write_shards
from fathom.sources.tree import crawl

NOW = 1_700_000_000
COLS = "path string, type string, mode int, uid long, gid long, size long, inode long, dev_major int, dev_minor int, nlink long, atime long, mtime long, ctime long"


def rec(path, type="f", uid=1, size=10, inode=1, nlink=1, t=NOW):
    return (path, type, 0o644, uid, 1, size, inode, 8, 0, nlink, t, t, t)


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "tree"
    (top / "sub").mkdir(parents=True)
    (top / "a.txt").write_text("hello\n")
    os.link(top / "a.txt", top / "a_hard")
    (top / "sub/b.txt").write_text("world\n")
    os.symlink("a.txt", top / "link_a")
    return str(top)


def test_crawl_of_a_small_tree(spark, tree):
    records = crawl(spark, tree, spread=2)
    t = summary.crawl_totals(records).first()
    assert (t.entries, t.dirs, t.files, t.hardlink_files, t.symlinks, t.other, t.total_bytes) == (6, 2, 3, 2, 1, 0, 12)
    assert t.entries == t.dirs + t.files + t.symlinks + t.other
    s = summary.totals(records).first()
    assert (s.scanned, s.matched, s.files, s.dirs, s.links, s.distinct_uids) == (6, 6, 3, 2, 1, 1)
    assert s.total_bytes == 12


def test_margins_add_up(spark):
    rows = [rec(f"/d/{i}", size=4**i, inode=i, t=NOW - i * 86400 * 40) for i in range(18)]
    grid = heatmap.cells(spark.createDataFrame(rows, COLS), NOW)
    m = {(r.age_bucket, r.size_bucket): r.files for r in heatmap.margins(grid).collect()}
    assert m[-1, -1] == 18 == sum(v for (a, s), v in m.items() if a >= 0 and s >= 0) == sum(v for (a, s), v in m.items() if a == -1 and s >= 0)


def test_links_across_crawls_are_credited_once(spark):
    one, two = [rec("/a/x", inode=5, nlink=2)], [rec("/b/x", inode=5, nlink=2), rec("/b/y", inode=6)]
    t = summary.totals(spark.createDataFrame(one + two, COLS)).first()
    assert (t.files, t.total_bytes) == (3, 20)


@pytest.mark.parametrize(
    "paths, base",
    [(["/a/b/file1", "/a/b/file2"], "/a/b"), (["/a/b/001/x", "/a/b/001/y/z"], "/a/b/001"), (["/a/f"], "/a/f"), (["/a", "/b"], "/"), (["/a//b/x", "/a//b/y"], "/a//b")],
)
def test_base_of_a_bucket(spark, paths, base):
    files = heatmap.bucketed(spark.createDataFrame([rec(p, inode=i) for i, p in enumerate(paths)], COLS), NOW)
    assert [r.base for r in rollup.base_prefixes(files).collect()] == [base]


def test_rollup_counts_directories_and_all_types(spark):
    rows = [rec("/r/a/1"), rec("/r/a/2", inode=2), rec("/r/b/1", inode=3), rec("/r/a", "d", size=4), rec("/r/a/l", "l", size=1)]
    got = {(r.level, r.row_path): (r.bucket_files, r.total_files, r.total_dirs, r.total_bytes) for r in rollup.rollup(spark.createDataFrame(rows, COLS), NOW, levels=2).collect()}
    assert got[1, "/r/a"] == (2, 2, 1, 25)
    assert got[2, "/r/a/1"] == (1, 1, 0, 10)


def test_packed_shards(spark, tmp_path):
    rows = [rec(f"/x/é{i}", uid=i % 5, size=2**62 + i, inode=-i - 1) for i in range(50)]
    df = spark.createDataFrame(rows, COLS)
    folder = str(tmp_path / "shards")
    assert write_shards(df, folder, 4) == 4
    cols = [c for c in df.columns]
    assert sorted(map(tuple, read_shards(spark, folder).select(cols).collect())) == sorted(map(tuple, df.collect()))
    assert {r.uid for r in read_shards(spark, folder, 3, 4).collect()} == {3}
    assert {r.status for r in shard_report(spark, folder).collect()} == {"ok"}


def test_repair(spark, tmp_path):
    keys = [c.split()[0] for c in COLS.split(", ")]
    body = encode([dict(zip(keys, rec(f"/p/{i}"))) for i in range(2)])
    good = HEADER.pack(MAGIC, 3, 0) + body
    files = {"uid_shard_0.bin": good, "uid_shard_1.bin": good[:-3], "uid_shard_2.bin": b"0123456789", "uid_shard_3.bin": HEADER.pack(OLD_MAGIC, 2, 0) + body, "other.bin": good}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    assert judge(good) == (2, len(good), "current", "ok")
    report = {r.name: r.status for r in shard_report(spark, str(tmp_path)).collect()}
    assert report == {"uid_shard_0.bin": "ok", "uid_shard_1.bin": "truncate", "uid_shard_2.bin": "quarantine", "uid_shard_3.bin": "header_rewrite"}
    cut = tail_summary(shard_report(spark, str(tmp_path))).first()
    assert (cut.shards, cut.bytes_removed) == (1, len(good) - 3 - scan(good[:-3])[1])
    assert unready(spark, str(tmp_path)) == sorted(report)  # no sidecars yet
    assert not any(r["error"] for r in repair(spark, str(tmp_path), dry_run=False))
    assert unready(spark, str(tmp_path)) == []
    after = {r.name: (r.status, r.records, r.sidecar_ok) for r in shard_report(spark, str(tmp_path)).collect()}
    assert after == {"uid_shard_0.bin": ("ok", 2, True), "uid_shard_1.bin": ("ok", 1, True), "uid_shard_3.bin": ("ok", 2, True)}
    assert (tmp_path / "corrupt_shards/uid_shard_2.bin").exists()


def test_sidecar_rules():
    assert read_sidecar(sidecar([16, 100]), 200) == [16, 100]
    assert read_sidecar(sidecar([17, 100]), 200) is None
    assert read_sidecar(sidecar([16, 300]), 200) is None
    assert read_sidecar(sidecar([16, 100, 100]), 200) is None


def test_layout_prunes_to_one_shard(spark, tmp_path):
    df = spark.createDataFrame([rec(f"/x/{i}", uid=i) for i in range(20)], COLS)
    write_records(df, str(tmp_path / "a"), 8)
    one = of_owner(spark.read.parquet(str(tmp_path / "a")), 11, 8)
    assert [r.uid for r in one.collect()] == [11]
    assert "uid_shard" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
    assert read_all(spark, [str(tmp_path / "a")] * 2).count() == 40


def test_manifests(spark, tmp_path):
    (tmp_path / "m1").write_text(manifest_text("/data", 8, 100, 160.5))
    (tmp_path / "m2").write_text(manifest_text("/more", 16, 50, 90, "/shown"))
    rows = {r.label: r for r in read_manifests(spark, [str(tmp_path / "m1"), str(tmp_path / "m2")]).collect()}
    assert rows["/data"].uid_shards == 8 and rows["/shown"].start == 50
    with pytest.raises(ValueError):
        one_layout(read_manifests(spark, [str(tmp_path / "m1"), str(tmp_path / "m2")]))
    (tmp_path / "uid.txt").write_text("7 ann\n8 UNKNOWN\n7 later\n")
    assert {(r.uid, r.name) for r in owner_names(spark, str(tmp_path / "uid.txt")).collect()} == {(7, "ann"), (8, "UNKNOWN")}


def test_search_equals_scan(spark, tmp_path):
    paths = ["/Data/Report.TXT", "/data/report", "/d/re/port", "/é/naïve", "/x/ab", "/data/report"]
    index = PathIndex.build(spark.createDataFrame([rec(p) for p in paths], COLS), str(tmp_path))
    for term in ("report", "REPORT.t", "naï", "/re", "zzz", "dat"):
        want = sorted(p for p in paths if any(term.lower() in s.lower() for s in p.split("/")))
        assert sorted(r.path for r in index.search(term).collect()) == want, term
    assert sorted(r.path_id for r in spark.read.parquet(f"{tmp_path}/paths").collect()) == list(range(6))
    body = json.loads(index.answer("report", 1, 1))
    assert body["total"] == 3 and len(body["paths"]) == 1
    with pytest.raises(ValueError):
        term_of("ab")
    assert search_answer(index, "q=ab")[0] == 400 and search_answer(None, "q=abc")[0] == 404
    assert search_answer(index, "q=report&limit=0")[0] == 400 and search_answer(index, "q=report&limit=2")[1]["total"] == 3


def test_retention(spark):
    old, new = NOW - 100 * 86400, NOW
    rows = [rec("/r/a/old", t=old), rec("/r/a/b/old", t=old), rec("/r/c/new", t=new), rec("/r/c/old", t=old), rec("/r/e", "d"), rec("/rx/old", t=old), rec("/r/c/before1970", t=-5)]
    df = spark.createDataFrame(rows, COLS)
    gone = {r.path for r in retention.candidates(df, "/r", "mtime", 100, NOW).collect()}
    assert gone == {"/r/a/old", "/r/a/b/old", "/r/c/old", "/r/c/before1970"}
    dirs = [r.path for r in retention.empty_directories(df, "/r", "mtime", 100, NOW).orderBy(F.desc("depth"), "path").collect()]
    assert dirs == ["/r/a/b", "/r/a", "/r/e"]
    with pytest.raises(ValueError):
        retention.eligible("effective", 5, NOW)


def test_command_line(spark, tree, tmp_path, capsys):
    out = str(tmp_path / "crawl")
    assert cli.main(["crawl", tree, out, "--shards", "8", "--record-root", "/shown"]) == 0
    assert "entries=6" in capsys.readouterr().out
    assert cli.main(["report", out, "--bucket-details", "2", "--report-dir", str(tmp_path / "rep"), "--now", str(int(time.time()))]) == 0
    assert "total_bytes=12" in capsys.readouterr().out
    assert len(os.listdir(tmp_path / "rep")) == 37
    assert cli.main(["index", out, "--index-dir", str(tmp_path / "idx")]) == 0
    assert "indexed_paths=6" in capsys.readouterr().out
    assert cli.main(["search", "HARD", "--index-dir", str(tmp_path / "idx")]) == 0
    assert capsys.readouterr().out == "/shown/a_hard\n"
    assert cli.main(["search", "ab", "--index-dir", str(tmp_path / "idx")]) == 1
    assert cli.main(["delete", out, "/shown"]) == 0
    assert "would_delete=4" in capsys.readouterr().out


def test_names_that_are_no_utf8(spark, tmp_path):
    top = tmp_path / "odd"
    top.mkdir()
    with open(os.fsencode(top) + b"/bad\xff", "w"):
        pass
    os.mkdir(os.fsencode(top) + b"/dir\xfe")
    with open(os.fsencode(top) + b"/dir\xfe/in", "w"):
        pass
    errors = spark.sparkContext.accumulator(0)
    for spread in (1, 3):
        paths = {r.path for r in crawl(spark, str(top), spread, errors).collect()}
        assert paths == {str(top), f"{top}/bad\\xff", f"{top}/dir\\xfe", f"{top}/dir\\xfe/in"}
    assert errors.value == 0
    assert crawl(spark, str(tmp_path / "absent"), errors=errors).count() == 0 and errors.value == 1


def test_long_paths_are_no_silent_loss():
    keys = [c.split()[0] for c in COLS.split(", ")]
    with pytest.raises(ValueError):
        encode([dict(zip(keys, rec("/" + "x" * 70_000)))])


def test_resumed_index(spark, tmp_path):
    folder = str(tmp_path)
    assert PathIndex(spark, folder).meta() == {"indexed_paths": 0, "trigram_records": 0, "unique_trigrams": 0}
    with pytest.raises(ValueError):
        PathIndex.resume(spark, folder)
    whole = PathIndex.build(spark.createDataFrame([rec("/a/report"), rec("/b/other")], COLS), folder).meta()
    shutil.rmtree(f"{folder}/postings"), shutil.rmtree(f"{folder}/meta")
    assert PathIndex.resume(spark, folder).meta() == whole
    assert [r.path for r in PathIndex(spark, folder).search("report").collect()] == ["/a/report"]


def test_delete_with_a_question(spark, tmp_path, monkeypatch, capsys):
    top, out = tmp_path / "data", str(tmp_path / "crawl")
    (top / "a/b").mkdir(parents=True)
    for name, age in (("a/b/old", 200), ("a/b/touched", 200), ("new", 0)):
        (top / name).write_text("x")
        os.utime(top / name, (time.time() - age * 86400,) * 2)
    (top / "c").mkdir()
    (top / "c/old").write_text("x")
    os.utime(top / "c/old", (0, 0))
    assert cli.main(["crawl", str(top), out, "--shards", "8"]) == 0
    assert "errors=0" in capsys.readouterr().out
    assert f"{os.getuid()} " in (tmp_path / "crawl/uid.txt").read_text()
    rule = ["delete", out, str(top), "--basis", "mtime", "--days", "100"]
    monkeypatch.setattr("builtins.input", lambda _: "no")
    assert cli.main([*rule, "--execute"]) == 3 and (top / "c/old").exists()
    os.utime(top / "a/b/touched")  # since the crawl
    monkeypatch.setattr("builtins.input", lambda _: "YES")
    assert cli.main([*rule, "--execute"]) == 1  # a/b is not empty after all
    shown = capsys.readouterr().out
    assert "deleted_files=2\nkept_files=1\nremoved_empty_dirs=1\nerrors=2\n" in shown
    assert not (top / "c").exists() and not (top / "a/b/old").exists() and (top / "a/b/touched").exists() and (top / "new").exists()


def test_packed_shards_on_the_command_line(spark, tmp_path, capsys):
    folder = str(tmp_path / "shards")
    write_shards(spark.createDataFrame([rec(f"/x/{i}", uid=i % 3, inode=i) for i in range(9)], COLS), folder, 4)
    assert cli.main(["report", folder, "--uid", "2", "--report-dir", str(tmp_path / "rep"), "--now", str(NOW)]) == 0
    assert "matched=3" in capsys.readouterr().out
    assert cli.main(["repair", folder]) == 0
    assert "not_ready=0" in capsys.readouterr().out
    assert cli.owner("root") == 0
