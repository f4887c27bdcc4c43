"""Printed numbers, shown paths, posting lists and job lists."""

import pytest
from pyspark.sql import functions as F

from fathom.functions import formats, paths
from fathom.jobs import read_jobs
from fathom.sources.manifest import default_folder
from fathom.sources.postings import decode_gaps, encode_gaps


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "f, v, want",
    [
        (formats.human_bytes, 0, "0.00B"), (formats.human_bytes, 12544, "12.2K"), (formats.human_bytes, 102400, "100K"), (formats.human_bytes, 2**60, "1024P"),
        (formats.human_count, 999, "999"), (formats.human_count, 12345, "12.3K"), (formats.short_count, 7, "7.00"), (formats.short_count, 12345, "12.3K"),
        (formats.binary_bytes, 1023, "1023 B"), (formats.binary_bytes, 1536, "1.50 KiB"), (formats.binary_bytes, 3 * 2**40, "3.00 TiB"),
        (formats.commas, 1234567, "1,234,567"), (formats.pretty_count, 1499999, "1,499,999 (1M)"), (formats.pretty_count, 12, "12"),
        (formats.rough_duration, 594, "59.4 s"), (formats.rough_duration, 18000, "30.0 min"), (formats.rough_duration, 90000, "2.50 h"), (formats.rough_duration, 1728000, "2.00 days"),
        (formats.duration, 3661, "01:01:01"), (formats.duration, -5, "00:00:00"), (formats.duration, 360000, "100:00:00"), (formats.wall_clock, 0, "1970-01-01 00:00:00 UTC"),
    ],
)
def test_numbers(spark, f, v, want):
    assert one(spark, f(F.lit(v).cast("long"))) == want


def test_cell_notes(spark):
    note = lambda f, s, t: one(spark, formats.count_note(F.lit(f).cast("long"), F.lit(s).cast("long"), F.lit(t).cast("long")))
    assert note(12, 1, 8) == "(12%)" and note(2_500_000, 1, 2) == "(3M, 50%)" and note(5, 0, 0) == "(0%)"


def test_escapes_and_names(spark):
    assert one(spark, formats.html_escape(F.lit('a<b>&"c'))) == "a&lt;b&gt;&amp;&quot;c"
    assert one(spark, formats.safe_name(F.lit("a/b:c\\d"))) == "a_b_c_d" and one(spark, formats.safe_name(F.lit(""))) == "tmp"
    assert default_folder("host", 0) == "host_jan-01-1970_00-00-00"


@pytest.mark.parametrize(
    "path, base, level, want",
    [
        ("/a/b/c", "", 1, "/a/b/"), ("/c", "", 1, "/"), ("c", "", 1, ""), ("/srv/" + "x" * 30 + "/y/z", "", 1, ".../" + "x" * 30 + "/y/"),
        ("/srv/base/one/two", "/srv/base", 2, ".../one/"), ("/srv/base/one", "/srv/base", 2, ".../"), ("/other/one", "/srv/base", 2, "/other/"),
    ],
)
def test_shown_lead(spark, path, base, level, want):
    assert one(spark, paths.shown_lead(F.lit(path), F.lit(base), level)) == want


@pytest.mark.parametrize("path, want", [("/m", "/new"), ("/m/a", "/new/a"), ("/mx/a", "/mx/a"), ("/", "/")])
def test_rewritten(spark, path, want):
    assert one(spark, paths.rewritten(F.lit(path), "/m/", "/new/")) == want


def test_trigrams_are_bytes_of_one_name(spark):
    def brute(p):
        out = set()
        for s in p.split("/"):
            b = bytes(c + 32 if 65 <= c <= 90 else c for c in s.encode())
            out |= {b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)}
        return sorted(out)

    for p in ("/A/bc/Défg", "ab", "", "//x//yzé", "/日本語/abcABC"):
        assert one(spark, paths.path_trigrams(F.lit(p))) == brute(p)


def test_posting_lists():
    for ids in ([], [0], [0, 1, 2], [5, 300, 70000, 2**40]):
        assert decode_gaps(encode_gaps(ids)) == ids
    with pytest.raises(ValueError):
        decode_gaps(b"\x80")
    with pytest.raises(ValueError):
        decode_gaps(b"\x80" * 10)


def test_job_lists():
    jobs = read_jobs("# c\nDEST = no\nDEST= there \nODD\n\n---jobs---\n/a\t/out\n/b\t/out2\t/shown\n", frozenset({"DEST"}))
    assert jobs.settings == {"DEST": "there"} and len(jobs.ignored) == 2
    assert [(j.start, j.output, j.shown) for j in jobs.jobs] == [("/a", "/out", None), ("/b", "/out2", "/shown")]
    with pytest.raises(ValueError):
        read_jobs("---jobs---\n/a /out\n")
