"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "heatmap_effective", "heatmap_margins_cube", "summary_totals_all_users", "summary_by_uid", "crawl_totals", "hardlink_credit", "bucket_base_prefix",
    "bucket_dir_rollup_top200", "path_search", "path_search_count", "trigram_postings_stats", "delete_candidates_mtime", "empty_dir_closure", "events_rate_sliding",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from fathom.operators.search import PathIndex
    from fathom.plans.catalogue import QUERIES, index_folder
    from fathom.sources.adapters import lineitem_records

    times: dict[str, float] = {}

    def timed(name, f):
        f()  # compiles code
        times[name] = min(_run(f) for _ in range(2))

    def _run(f) -> float:
        t = time.perf_counter()
        f()
        return round(time.perf_counter() - t, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    folder = index_folder(spark)
    times["index_build"] = _run(lambda: PathIndex.build(lineitem_records(spark, sf_dir), folder))
    index = PathIndex(spark, folder)
    timed("index_search", lambda: index.search("order_12345").write.format("noop").mode("overwrite").save())
    timed("index_candidates", lambda: index.candidates("order_12345").write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
