"""Named queries over the driver's tables, each with its SQL for DuckDB.

Records come from `lineitem` (sources.adapters); `NOW` is fixed. Sums are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import formats
from fathom.functions.buckets import age_bucket, badge_visible, change_led, size_bucket, uid_shard
from fathom.functions.paths import rewritten
from fathom.operators import credit, heatmap, rates, retention, rollup, search, summary
from fathom.schema import AGE_BOUNDS_DAYS, SIZE_BOUNDS
from fathom.sources.adapters import LINEITEM_SQL, NOW, lineitem_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

OWNER, SHARDS, OLD_DAYS, ROOT = 1007, 64, 1095, "/srv/proj3"


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- SQL pieces

CREDIT_SQL = "acct AS (SELECT *, CASE WHEN type = 'f' AND nlink > 1 AND row_number() OVER (PARTITION BY type = 'f' AND nlink > 1, dev_major, dev_minor, inode ORDER BY path, size, mtime, atime, ctime) > 1 THEN 0 ELSE size END AS credited FROM crawl)"
LED_SQL = "(ctime - greatest(atime, mtime) >= 15552000)"


def size_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN {i}" for i, b in enumerate(SIZE_BOUNDS)) + " ELSE 5 END"


def age_sql(x: str) -> str:
    days = f"(({NOW} - {x}) // 86400)"
    return f"CASE WHEN {x} <= 0 OR {x} > {NOW} THEN 0 " + " ".join(f"WHEN {days} < {b} THEN {i}" for i, b in enumerate(AGE_BOUNDS_DAYS)) + " ELSE 5 END"


def basis_sql(basis: str) -> str:
    return "greatest(atime, mtime, ctime)" if basis == "effective" else basis


def with_sql(body: str, *more: str) -> str:
    return "WITH " + ", ".join([LINEITEM_SQL, CREDIT_SQL, *more]) + " " + body


def files_sql(basis: str = "effective") -> str:
    return f"files AS (SELECT *, {age_sql(basis_sql(basis))} AS age_bucket, {size_sql('size')} AS size_bucket, {LED_SQL} AS led FROM acct WHERE type = 'f')"


MEASURES_SQL = "count(*) AS files, sum(credited)::BIGINT AS bytes, count(*) FILTER (WHERE led) AS led_files, coalesce(sum(credited) FILTER (WHERE led), 0)::BIGINT AS led_bytes"
CELLS_SQL = f"cells AS (SELECT age_bucket, size_bucket, {MEASURES_SQL} FROM files GROUP BY ALL)"

# ---------------------------------------------------------------- heat map

for _basis in ("effective", "atime", "mtime", "ctime"):
    query(f"heatmap_{_basis}", with_sql("SELECT * FROM cells", files_sql(_basis), CELLS_SQL))(lambda spark, d, basis=_basis: heatmap.cells(lineitem_records(spark, d), NOW, basis))


def grid(spark: SparkSession, d: str) -> DataFrame:
    return heatmap.cells(lineitem_records(spark, d), NOW)


@query("heatmap_single_user", f"WITH {LINEITEM_SQL.replace('FROM lineitem))', f'FROM lineitem WHERE 1000 + l_suppkey = {OWNER}))')}, {CREDIT_SQL}, {files_sql()}, {CELLS_SQL} SELECT * FROM cells")
def _(spark, d):
    return heatmap.cells(lineitem_records(spark, d).where(F.col("uid") == OWNER), NOW)


@query("heatmap_margins_cube", with_sql("SELECT coalesce(age_bucket, -1)::INT AS age_bucket, coalesce(size_bucket, -1)::INT AS size_bucket, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(led_files)::BIGINT AS led_files, sum(led_bytes)::BIGINT AS led_bytes FROM cells GROUP BY CUBE (age_bucket, size_bucket)", files_sql(), CELLS_SQL))
def _(spark, d):
    return heatmap.margins(grid(spark, d))


@query("heatmap_shares", with_sql("SELECT age_bucket, size_bucket, round(100.0::DOUBLE * files / sum(files) OVER (), 6) AS files_percent, round(100.0::DOUBLE * bytes / sum(bytes)  OVER (), 6) AS bytes_percent, round(100.0::DOUBLE * files / max(files) OVER (), 6) AS files_heat, round(100.0::DOUBLE * bytes / max(bytes) OVER (), 6) AS bytes_heat FROM cells", files_sql(), CELLS_SQL))
def _(spark, d):
    return heatmap.shares(grid(spark, d)).select("age_bucket", "size_bucket", *[F.round(c, 6).alias(c) for c in ("files_percent", "bytes_percent", "files_heat", "bytes_heat")])


def colour_sql(x: str, ramp) -> str:
    part = [f"floor({a} + {b - a} * least(greatest({x} / 100.0::DOUBLE, 0), 1) + 0.5)::INT" for a, b in zip(*ramp)]
    return "'rgb(' || " + " || ',' || ".join(part) + " || ')'"


@query("heatmap_colours", with_sql(f"SELECT age_bucket, size_bucket, {colour_sql('fh', formats.ROSE)} AS files_colour, {colour_sql('bh', formats.BLUE)} AS bytes_colour FROM (SELECT *, 100.0::DOUBLE * files / max(files) OVER () AS fh, 100.0::DOUBLE * bytes / max(bytes) OVER () AS bh FROM cells)", files_sql(), CELLS_SQL))
def _(spark, d):
    return heatmap.shares(grid(spark, d)).select("age_bucket", "size_bucket", "files_colour", "bytes_colour")


@query("heatmap_dense_grid", with_sql("SELECT a::INT AS age_bucket, s::INT AS size_bucket, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, coalesce(led_files, 0) AS led_files, coalesce(led_bytes, 0) AS led_bytes FROM range(6) x(a) CROSS JOIN range(6) y(s) LEFT JOIN cells ON a = age_bucket AND s = size_bucket", files_sql(), CELLS_SQL))
def _(spark, d):
    return heatmap.dense(grid(spark, d))


@query("ctime_led_by_cell", with_sql("SELECT age_bucket, size_bucket, led_files, led_bytes FROM cells WHERE led_files > 0", files_sql(), CELLS_SQL))
def _(spark, d):
    return grid(spark, d).where("led_files > 0").select("age_bucket", "size_bucket", "led_files", "led_bytes")


@query("ctime_led_badges", with_sql("SELECT age_bucket, size_bucket, bytes, led_bytes, CASE WHEN bytes = 0 OR led_bytes = 0 THEN '0%' WHEN p < 1 THEN '<1%' WHEN p < 10 THEN printf('%.1f%%', p) ELSE printf('%.0f%%', p) END AS label, bytes > 0 AND led_bytes > 0 AND p >= 30 AS visible FROM (SELECT *, 100.0::DOUBLE * led_bytes / bytes AS p FROM cells)", files_sql(), CELLS_SQL))
def _(spark, d):
    return heatmap.badges(grid(spark, d))


# ---------------------------------------------------------------- totals

TOTALS_SQL = f"""SELECT count(*) AS matched, count(*) FILTER (WHERE type = 'f') AS files, count(*) FILTER (WHERE type = 'd') AS dirs, count(*) FILTER (WHERE type = 'l') AS links,
 count(*) FILTER (WHERE type NOT IN ('f', 'd', 'l')) AS others, coalesce(sum(credited) FILTER (WHERE type = 'f'), 0)::BIGINT AS total_bytes, coalesce(sum(size) FILTER (WHERE type NOT IN ('f', 'd', 'l')), 0)::BIGINT AS total_other_bytes,
 coalesce(sum(credited), 0)::BIGINT AS total_capacity_bytes, count(*) FILTER (WHERE type <> 'f') AS non_files, coalesce(sum(size) FILTER (WHERE type <> 'f'), 0)::BIGINT AS capacity_in_non_files,
 count(*) FILTER (WHERE type = 'f' AND {LED_SQL}) AS led_files, coalesce(sum(credited) FILTER (WHERE type = 'f' AND {LED_SQL}), 0)::BIGINT AS led_bytes, count(DISTINCT uid) AS distinct_uids, (SELECT count(*) FROM lineitem) AS scanned FROM acct"""


@query("summary_totals_all_users", with_sql(TOTALS_SQL))
def _(spark, d):
    return summary.totals(lineitem_records(spark, d))


@query("summary_totals_single_user", with_sql(TOTALS_SQL).replace("FROM lineitem))", f"FROM lineitem WHERE 1000 + l_suppkey = {OWNER}))"))
def _(spark, d):
    return summary.totals(lineitem_records(spark, d), OWNER)


@query("summary_by_uid", with_sql("SELECT uid, count(*) AS records, count(*) FILTER (WHERE type = 'f') AS files, coalesce(sum(credited) FILTER (WHERE type = 'f'), 0)::BIGINT AS bytes FROM acct GROUP BY uid"))
def _(spark, d):
    return summary.by_uid(lineitem_records(spark, d))


@query("crawl_totals", with_sql("SELECT count(*) AS entries, count(*) FILTER (WHERE type = 'd') AS dirs, count(*) FILTER (WHERE type = 'f') AS files, count(*) FILTER (WHERE type = 'f' AND nlink > 1) AS hardlink_files, count(*) FILTER (WHERE type = 'l') AS symlinks, count(*) FILTER (WHERE type NOT IN ('f', 'd', 'l')) AS other, sum(credited) FILTER (WHERE type = 'f')::BIGINT AS total_bytes, sum(size) FILTER (WHERE type = 'd')::BIGINT AS dir_bytes, sum(size) FILTER (WHERE type = 'l')::BIGINT AS symlink_bytes, sum(size) FILTER (WHERE type NOT IN ('f', 'd', 'l'))::BIGINT AS other_bytes, sum(size)::BIGINT AS apparent_bytes FROM acct"))
def _(spark, d):
    return summary.crawl_totals(lineitem_records(spark, d))


@query("type_dispatch_counts", with_sql("SELECT type, count(*) AS n, sum(size)::BIGINT AS bytes FROM crawl GROUP BY type"))
def _(spark, d):
    return lineitem_records(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("hardlink_credit", with_sql("SELECT dev_major, dev_minor, inode, path, size FROM crawl WHERE type = 'f' AND nlink > 1 QUALIFY row_number() OVER (PARTITION BY dev_major, dev_minor, inode ORDER BY path, size, mtime, atime, ctime) = 1"))
def _(spark, d):
    return credit.winners(lineitem_records(spark, d)).select("dev_major", "dev_minor", "inode", "path", "size")


ODD = [("/a", "f", 1, 5, 7, 2), ("/b", "f", 2, 6, 7, 2), ("/c", "f", 3, 7, 8, None), ("/d", None, 4, 8, 9, 2), (None, "f", 5, 9, None, 3), ("/e", "d", 6, None, 9, 2)]
ODD_COLUMNS = "path, type, uid, size, inode, nlink"


def odd_sql() -> str:
    value = lambda x: "NULL" if x is None else repr(x)
    return f"odd AS (SELECT path::VARCHAR AS path, type::VARCHAR AS type, uid::BIGINT AS uid, size::BIGINT AS size, inode::BIGINT AS inode, nlink::BIGINT AS nlink FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in ODD)}) t({ODD_COLUMNS}))"


@query("credit_with_nulls", f"WITH {odd_sql()} SELECT uid, CASE WHEN coalesce(type = 'f' AND nlink > 1, false) AND row_number() OVER (PARTITION BY coalesce(type = 'f' AND nlink > 1, false), inode ORDER BY path NULLS FIRST, size NULLS FIRST) > 1 THEN 0 ELSE size END AS credited FROM odd")
def _(spark, d):
    rows = spark.createDataFrame(ODD, "path string, type string, uid long, size long, inode long, nlink long")
    zero = F.lit(0).cast("long")
    return credit.with_credit(rows.withColumns({c: zero for c in ("dev_major", "dev_minor", "mtime", "atime", "ctime")})).select("uid", "credited")


@query("unique_file_bytes", with_sql("SELECT sum(credited)::BIGINT AS bytes, count(*) FILTER (WHERE credited > 0) AS credited_files FROM acct WHERE type = 'f'"))
def _(spark, d):
    return credit.with_credit(lineitem_records(spark, d).where("type = 'f'")).agg(F.sum("credited").alias("bytes"), F.count_if(F.col("credited") > 0).alias("credited_files"))


# ---------------------------------------------------------------- expressions on edge values

SIZE_EDGES = [0, *[x for b in SIZE_BOUNDS for x in (b - 1, b)]]
AGE_EDGES = [x for b in AGE_BOUNDS_DAYS for x in (b * 86400 - 1, b * 86400)]
TS_EDGES = [0, NOW + 1, -1, NOW, *[NOW - x for x in AGE_EDGES]]


def values_sql(name: str, values) -> str:
    return f"(VALUES {', '.join(f'({v}::BIGINT)' for v in values)}) t({name})"


@query("size_bucket_edges", f"SELECT size, {size_sql('size')} AS bucket FROM {values_sql('size', SIZE_EDGES)}")
def _(spark, d):
    return spark.createDataFrame([(v,) for v in SIZE_EDGES], "size long").select("size", size_bucket(F.col("size")).alias("bucket"))


@query("age_bucket_edges", f"SELECT ts, {age_sql('ts')} AS bucket FROM {values_sql('ts', TS_EDGES)}")
def _(spark, d):
    return spark.createDataFrame([(v,) for v in TS_EDGES], "ts long").select("ts", age_bucket(F.col("ts"), NOW).alias("bucket"))


LED_EDGES = [(100, 100, 100 + x) for x in (-1, 0, 15551999, 15552000)] + [(-1, 5, 10**9), (5, 5, -1), (5, 10**6, 10**6 + 15552000)]


@query("ctime_led_edges", f"SELECT atime, mtime, ctime, u(ctime) - greatest(u(atime), u(mtime)) >= 15552000 AS led FROM (VALUES {', '.join(f'({a}::BIGINT, {m}::BIGINT, {c}::BIGINT)' for a, m, c in LED_EDGES)}) t(atime, mtime, ctime)".replace("u(ctime)", "(CASE WHEN ctime < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END + ctime)").replace("u(atime)", "(CASE WHEN atime < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END + atime)").replace("u(mtime)", "(CASE WHEN mtime < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END + mtime)"))
def _(spark, d):
    return spark.createDataFrame(LED_EDGES, "atime long, mtime long, ctime long").select("atime", "mtime", "ctime", change_led().alias("led"))


BYTES = [0, 1, 999, 1023, 1024, 1536, 10239, 10240, 12544, 102399, 102400, 1048575, 1048576, 15 * 10**8, 2**40 + 2**39, 2**50 * 3 // 2, 2**52]


def human_bytes_sql(v: str) -> str:
    forms = " ".join(f"WHEN {v} >= {1024**k} THEN CASE WHEN {v} >= {100 * 1024**k} THEN printf('%.0f{u}', {v} / {1024**k}.0::DOUBLE) WHEN {v} >= {10 * 1024**k} THEN printf('%.1f{u}', {v} / {1024**k}.0::DOUBLE) ELSE printf('%.2f{u}', {v} / {1024**k}.0::DOUBLE) END" for k, u in reversed(list(enumerate(formats.BYTE_UNITS))) if k)
    return f"CASE {forms} WHEN {v} >= 100 THEN printf('%.0fB', {v}::DOUBLE) WHEN {v} >= 10 THEN printf('%.1fB', {v}::DOUBLE) ELSE printf('%.2fB', {v}::DOUBLE) END"


@query("format_human_bytes", with_sql(f"SELECT v, {human_bytes_sql('v')} AS label FROM (SELECT * FROM {values_sql('v', BYTES)} UNION SELECT size FROM crawl)"))
def _(spark, d):
    sizes = spark.createDataFrame([(v,) for v in BYTES], "v long").union(lineitem_records(spark, d).select("size")).distinct()
    return sizes.select("v", formats.human_bytes(F.col("v")).alias("label"))


COUNTS = [0, 7, 999, 1000, 12345, 999999, 1000000, 1499999, 1500000, 2500000, 123456789, 10**9, 5 * 10**9 // 2, 10**12, 15 * 10**11]


@query("format_counts", f"SELECT v, printf('%,d', v) AS commas, CASE WHEN v < 1000000 THEN '' WHEN v >= 1000000000000 THEN '(' || ((v + 500000000000) // 1000000000000) || 'T)' WHEN v >= 1000000000 THEN '(' || ((v + 500000000) // 1000000000) || 'B)' ELSE '(' || ((v + 500000) // 1000000) || 'M)' END AS suffix FROM {values_sql('v', COUNTS)}".replace("printf('%,d', v)", "format('{:,}', v)"))
def _(spark, d):
    return spark.createDataFrame([(v,) for v in COUNTS], "v long").select("v", formats.commas(F.col("v")).alias("commas"), formats.rounded_suffix(F.col("v")).alias("suffix"))


SHARES = [(0, 10), (0, 0), (1, 1000), (99, 10000), (1, 100), (299, 1000), (300, 1000), (25, 1000), (999, 10000), (1, 8), (125, 1000), (375, 1000), (10, 10)]


@query("format_led_label", f"SELECT led, total, CASE WHEN total = 0 OR led = 0 THEN '0%' WHEN p < 1 THEN '<1%' WHEN p < 10 THEN printf('%.1f%%', p) ELSE printf('%.0f%%', p) END AS label, total > 0 AND led > 0 AND led * 100 >= total * 30 AS visible FROM (SELECT *, CASE WHEN total > 0 THEN 100.0::DOUBLE * led / total ELSE 0 END AS p FROM (VALUES {', '.join(f'({a}::BIGINT, {b}::BIGINT)' for a, b in SHARES)}) t(led, total))")
def _(spark, d):
    return spark.createDataFrame(SHARES, "led long, total long").select("led", "total", formats.led_label(F.col("led"), F.col("total")).alias("label"), badge_visible(F.col("led"), F.col("total")).alias("visible"))


@query("html_escape_paths", "SELECT page_id, replace(replace(replace(replace(url || '<&\">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", formats.html_escape(F.concat("url", F.lit('<&">'))).alias("escaped"))


# ---------------------------------------------------------------- layout


@query("uid_shard_distribution", with_sql(f"SELECT (uid & {SHARDS - 1})::BIGINT AS shard, count(*) AS n, count(DISTINCT uid) AS uids FROM crawl GROUP BY shard"))
def _(spark, d):
    return lineitem_records(spark, d).groupBy(uid_shard(F.col("uid"), SHARDS).alias("shard")).agg(F.count("*").alias("n"), F.count_distinct("uid").alias("uids"))


@query("uid_shard_pruned_scan", with_sql(f"SELECT path, size FROM crawl WHERE uid = {OWNER}"))
def _(spark, d):
    from fathom.sources.layout import of_owner

    return of_owner(lineitem_records(spark, d).withColumn("uid_shard", uid_shard(F.col("uid"), SHARDS)), OWNER, SHARDS).select("path", "size")


@query("record_root_rewrite", with_sql("SELECT uid, path, CASE WHEN path = '/srv/proj3' THEN '/mnt/store' WHEN starts_with(path, '/srv/proj3/') THEN '/mnt/store' || substr(path, 11) ELSE path END AS shown FROM crawl WHERE type = 'd'"))
def _(spark, d):
    return lineitem_records(spark, d).where("type = 'd'").select("uid", "path", rewritten(F.col("path"), "/srv/proj3/", "/mnt/store").alias("shown"))


@query("user_name_join", with_sql("SELECT s_name AS owner, count(*) AS records, sum(credited)::BIGINT AS bytes FROM acct JOIN supplier ON uid = 1000 + s_suppkey GROUP BY s_name"))
def _(spark, d):
    names = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 1000).cast("long").alias("uid"), F.col("s_name").alias("owner"))
    return credit.with_credit(lineitem_records(spark, d)).groupBy("uid").agg(F.count("*").alias("records"), F.sum("credited").alias("bytes")).join(names, "uid").groupBy("owner").agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


@query("merge_two_crawls", with_sql("SELECT source_key % 2 = 0 AS even, count(*) AS records, sum(credited)::BIGINT AS bytes FROM acct GROUP BY even"))
def _(spark, d):
    # two crawls read as one: links are credited across both
    one = lineitem_records(spark, d)
    both = one.where("source_key % 2 = 0").unionByName(one.where("source_key % 2 <> 0"))
    return credit.with_credit(both).groupBy((F.col("source_key") % 2 == 0).alias("even")).agg(F.count("*").alias("records"), F.sum("credited").alias("bytes"))


TIMINGS = {"one": [(100, 160, 60.5)], "two": [(100, 160, 60.0), (200, 300, 99.0)], "odd": [(0, 10, 5.0), (100, 90, 5.0), (100, 100, 7.0), (100, 100, 9.0)]}
_rows = [(k, *v) for k, vs in TIMINGS.items() for v in vs]


@query("manifest_timing_merge", f"SELECT k, count(*) AS crawls, min(s) AS start, max(e) AS \"end\", CASE WHEN count(*) > 1 AND max(e) > min(s) THEN (max(e) - min(s))::DOUBLE ELSE max(x) END AS elapsed, count(*) > 1 AS merged FROM (VALUES {', '.join(f'({k!r}, {a}::BIGINT, {b}::BIGINT, {c}::DOUBLE)' for k, a, b, c in _rows)}) t(k, s, e, x) WHERE s > 0 AND e >= s GROUP BY k")
def _(spark, d):
    out = None
    for k, v in TIMINGS.items():
        one = summary.merged_timing(spark.createDataFrame(v, "start long, end long, elapsed double")).select(F.lit(k).alias("k"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- rollups

for _level in (1, 2, 3):
    query(f"path_components_rollup_l{_level}", with_sql(f"SELECT '/' || list_aggregate([x FOR x IN string_split(path, '/') IF x <> ''][1:{_level}], 'string_agg', '/') AS row_path, count(*) AS files, sum(credited)::BIGINT AS bytes FROM acct WHERE type = 'f' GROUP BY row_path"))(lambda spark, d, level=_level: rollup.level_totals(lineitem_records(spark, d), level))

BASE_SQL = """ends AS (SELECT age_bucket, size_bucket, min(path) AS a, max(path) AS b FROM files GROUP BY ALL),
common AS (SELECT *, substr(a, 1, (SELECT max(i) FROM range(0, 200) r(i) WHERE i <= length(a) AND substr(a, 1, i) = substr(b, 1, i))) AS raw FROM ends),
trimmed AS (SELECT *, CASE WHEN length(raw) > 1 THEN rtrim(raw, '/') ELSE raw END AS c FROM common),
bases AS (SELECT age_bucket, size_bucket, CASE WHEN bool_and(path = c OR starts_with(path, c || '/')) THEN any_value(c) ELSE any_value(regexp_replace(c, '/[^/]*$', '')) END AS base FROM files JOIN trimmed USING (age_bucket, size_bucket) GROUP BY ALL)"""


@query("bucket_base_prefix", with_sql("SELECT * FROM bases", files_sql(), BASE_SQL))
def _(spark, d):
    return rollup.base_prefixes(heatmap.bucketed(lineitem_records(spark, d), NOW))


ROLLUP_SQL = f"""rows_ AS (SELECT age_bucket, size_bucket, credited, led, k AS level, base || '/' || list_aggregate([x FOR x IN string_split(substr(path, length(base) + 2), '/') IF x <> ''][1:k], 'string_agg', '/') AS row_path
 FROM files JOIN bases USING (age_bucket, size_bucket), (VALUES (1), (2), (3)) l(k) WHERE len([x FOR x IN string_split(substr(path, length(base) + 2), '/') IF x <> '']) >= k),
mine AS (SELECT age_bucket, size_bucket, level, row_path, count(*) AS bucket_files, sum(credited)::BIGINT AS bucket_bytes, count(*) FILTER (WHERE led) AS led_files, coalesce(sum(credited) FILTER (WHERE led), 0)::BIGINT AS led_bytes FROM rows_ GROUP BY ALL),
ups AS (SELECT type, credited, '/' || list_aggregate([x FOR x IN string_split(path, '/') IF x <> ''][1:k], 'string_agg', '/') AS row_path FROM acct, range(1, 7) r(k) WHERE k <= len([x FOR x IN string_split(path, '/') IF x <> ''])),
tots AS (SELECT row_path, count(*) FILTER (WHERE type = 'f') AS total_files, count(*) FILTER (WHERE type = 'd') AS total_dirs, sum(credited)::BIGINT AS total_bytes FROM ups GROUP BY row_path),
ranked AS (SELECT m.*, coalesce(total_files, 0) AS total_files, coalesce(total_dirs, 0) AS total_dirs, coalesce(total_bytes, 0) AS total_bytes,
 row_number() OVER (PARTITION BY age_bucket, size_bucket, level ORDER BY bucket_bytes DESC, bucket_files DESC, row_path)::INT AS rank FROM mine m LEFT JOIN tots USING (row_path)),
shown AS (SELECT * FROM ranked WHERE rank <= 200)"""


@query("bucket_dir_rollup_top200", with_sql("SELECT * FROM shown", files_sql(), BASE_SQL, ROLLUP_SQL))
def _(spark, d):
    return rollup.top_rows(rollup.rollup(lineitem_records(spark, d), NOW, levels=3))


@query("bucket_dir_rollup_heat", with_sql("SELECT age_bucket, size_bucket, level, row_path, " + ", ".join(f"CASE WHEN max({c}) OVER w > 0 THEN round(100.0::DOUBLE * {c} / max({c}) OVER w, 6) ELSE 0 END AS {c}_heat" for c in ("total_files", "total_dirs", "total_bytes")) + " FROM shown WINDOW w AS (PARTITION BY age_bucket, size_bucket, level)", files_sql(), BASE_SQL, ROLLUP_SQL))
def _(spark, d):
    shown = rollup.heat(rollup.top_rows(rollup.rollup(lineitem_records(spark, d), NOW, levels=3)))
    return shown.select("age_bucket", "size_bucket", "level", "row_path", *[F.round(f"{c}_heat", 6).alias(f"{c}_heat") for c in ("total_files", "total_dirs", "total_bytes")])


# ---------------------------------------------------------------- search

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERM = "ORDER_12"
FOUND_SQL = f"ids AS (SELECT row_number() OVER (ORDER BY path, type, inode, size) - 1 AS path_id, path FROM crawl), hits AS (SELECT * FROM ids WHERE contains({LOWER_SQL.format('path')}, 'order_12'))"
GRAMS_SQL = f"segs AS (SELECT path_id, unnest(string_split({LOWER_SQL.format('path')}, '/')) AS s FROM ids), tri AS (SELECT DISTINCT path_id, substr(s, i, 3) AS g FROM segs, range(1, 60) r(i) WHERE i <= length(s) - 2), coded AS (SELECT path_id, ((ascii(g[1]) << 16) | (ascii(g[2]) << 8) | ascii(g[3]))::INT AS trigram FROM tri)"


@query("trigram_postings_stats", with_sql("SELECT count(*) AS trigram_records, count(DISTINCT trigram) AS unique_trigrams, count(DISTINCT path_id) AS indexed_paths FROM coded", FOUND_SQL, GRAMS_SQL))
def _(spark, d):
    return search.postings(search.numbered(lineitem_records(spark, d))).agg(F.count("*").alias("trigram_records"), F.count_distinct("trigram").alias("unique_trigrams"), F.count_distinct("path_id").alias("indexed_paths"))


@query("trigram_df_topk", with_sql("SELECT trigram, count(*) AS df FROM coded GROUP BY trigram ORDER BY df DESC, trigram LIMIT 100", FOUND_SQL, GRAMS_SQL))
def _(spark, d):
    return search.postings(search.numbered(lineitem_records(spark, d))).groupBy("trigram").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "trigram").limit(100)


@query("path_search", with_sql("SELECT path_id, path FROM hits", FOUND_SQL))
def _(spark, d):
    return search.matches(search.numbered(lineitem_records(spark, d)), TERM)


@query("path_search_indexed", with_sql("SELECT path_id, path FROM hits", FOUND_SQL))
def _(spark, d):
    return search.PathIndex.build(lineitem_records(spark, d), index_folder(spark)).search(TERM)


@query("path_search_page", with_sql("SELECT path_id, path, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY path_id LIMIT 25 OFFSET 10", FOUND_SQL))
def _(spark, d):
    return search.page(search.matches(search.numbered(lineitem_records(spark, d)), TERM), 10, 25)


@query("path_search_count", with_sql("SELECT count(*) AS total FROM hits", FOUND_SQL))
def _(spark, d):
    return search.matches(lineitem_records(spark, d), TERM).agg(F.count("*").alias("total"))


@query("path_search_slash_empty", with_sql("SELECT path FROM crawl WHERE false"))
def _(spark, d):
    return search.matches(lineitem_records(spark, d), "AF/Order").select("path")


@query("search_pages_url", f"SELECT page_id, url FROM (SELECT *, unnest(string_split({LOWER_SQL.format('url')}, '/')) AS s FROM pages) WHERE contains(s, 'page') GROUP BY ALL")
def _(spark, d):
    return search.matches(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url"), "page", "url")


@query("search_documents_source", f"SELECT doc_id, path FROM (SELECT doc_id, '/corpus/' || source || '/' || lang || '/doc_' || doc_id AS path FROM documents) WHERE contains({LOWER_SQL.format('path')}, 'src1')")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string")).alias("path"))
    return search.matches(docs, "SRC1")


@query("search_json", with_sql("SELECT '{\"path_id\":' || path_id || ',\"path\":\"' || path || '\"}' AS hit FROM hits", FOUND_SQL))
def _(spark, d):
    return search.matches(search.numbered(lineitem_records(spark, d)), TERM).select(F.to_json(F.struct("path_id", "path")).alias("hit"))


def index_folder(spark: SparkSession) -> str:
    """A new folder beside the other tables that sessions share; removed when the session ends."""
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base}/fathom-index-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


# ---------------------------------------------------------------- retention

for _basis in ("atime", "mtime", "ctime"):
    query(f"delete_candidates_{_basis}", with_sql(f"SELECT path, type, {_basis} AS ts FROM crawl WHERE type <> 'd' AND (path = '{ROOT}' OR starts_with(path, '{ROOT}/')) AND {_basis} <= {NOW - OLD_DAYS * 86400}"))(lambda spark, d, basis=_basis: retention.candidates(lineitem_records(spark, d), ROOT, basis, OLD_DAYS, NOW).select("path", "type", F.col(basis).alias("ts")))


@query("delete_all_candidates", with_sql(f"SELECT count(*) AS walk_entries, count(*) FILTER (WHERE type = 'd') AS dirs_seen, count(*) FILTER (WHERE type <> 'd') AS files_seen, count(*) FILTER (WHERE type <> 'd') AS would_delete FROM crawl WHERE starts_with(path, '{ROOT}/')"))
def _(spark, d):
    return retention.summary(lineitem_records(spark, d), ROOT)


@query("empty_dir_closure", with_sql(f"""SELECT path, (length(path) - length(replace(path, '/', '')))::BIGINT AS depth FROM dirs WHERE path NOT IN (SELECT path FROM kept)""", f"""inside AS (SELECT *, [x FOR x IN string_split(path, '/') IF x <> ''] AS c FROM crawl WHERE starts_with(path, '{ROOT}/')),
 above AS (SELECT type, mtime, '/' || list_aggregate(c[1:k], 'string_agg', '/') AS path FROM inside, range(3, 7) r(k) WHERE k < len(c)),
 dirs AS (SELECT path FROM above UNION SELECT path FROM inside WHERE type = 'd'), kept AS (SELECT DISTINCT path FROM above WHERE type <> 'd' AND mtime > {NOW - OLD_DAYS * 86400})"""))
def _(spark, d):
    return retention.empty_directories(lineitem_records(spark, d), ROOT, "mtime", OLD_DAYS, NOW)


# ---------------------------------------------------------------- rates


@query("events_rate_sliding", "WITH p AS (SELECT floor(epoch(ts))::BIGINT // 3600 AS pane, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, (sum(n) OVER (ORDER BY pane RANGE BETWEEN 9 PRECEDING AND CURRENT ROW))::BIGINT AS in_window, min(pane) OVER () AS first FROM p) SELECT pane, n, in_window, in_window::DOUBLE / least(10, pane - first + 1) AS rate FROM s")
def _(spark, d):
    return rates.sliding_rates(spark.read.parquet(f"{d}/events.parquet"), 3600, 10)


# ---------------------------------------------------------------- round trips


@query("bin_roundtrip", with_sql("SELECT type, count(*) AS n, sum(size)::BIGINT AS bytes FROM crawl GROUP BY type"))
def _(spark, d):
    from fathom.sources.shards import read_shards, write_shards

    folder = index_folder(spark)
    write_shards(lineitem_records(spark, d), folder, 8)
    return read_shards(spark, folder).groupBy("type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("repair_report")
def _(spark, d):
    from fathom.operators.repair import shard_report
    from fathom.sources.shards import write_shards

    folder = index_folder(spark)
    write_shards(lineitem_records(spark, d), folder, 4)
    return shard_report(spark, folder)


@query("render_report")
def _(spark, d):
    from fathom.render import report_html

    return spark.createDataFrame([(report_html(lineitem_records(spark, d), NOW),)], "html string")
