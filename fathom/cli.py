"""python -m fathom.cli crawl|report|index|search|repair|delete|serve ..."""

from __future__ import annotations

import argparse
import os
import pwd
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.render import key_values
from fathom.schema import BASES, UID_SHARDS


def session() -> SparkSession:
    return SparkSession.builder.appName("fathom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def owner(text: str) -> int:
    """An owner's id from itself or a login name."""
    if text.isdigit():
        return int(text)
    try:
        return pwd.getpwnam(text).pw_uid
    except KeyError:
        raise argparse.ArgumentTypeError(f"no such user: {text}") from None


def read_crawls(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """Several crawls as one, each written as Parquet or as packed shards; manifests, where there are any, must
    agree on the shards."""
    from fathom.sources.layout import read_all, union_all
    from fathom.sources.manifest import one_layout, read_manifests
    from fathom.sources.shards import read_shards

    manifests = [m for d in dirs if os.path.exists(m := f"{d}/crawl_manifest.txt")]
    if manifests:
        one_layout(read_manifests(spark, manifests))
    return union_all([read_all(spark, [f"{d}/records"]).drop("uid_shard") if os.path.isdir(f"{d}/records") else read_shards(spark, d) for d in dirs])


def write_names(records: DataFrame, folder: str) -> None:
    """uid.txt and gid.txt: each id that the records hold with its name on this machine."""
    import grp

    for column, name_of in (("uid", lambda i: pwd.getpwuid(i).pw_name), ("gid", lambda i: grp.getgrgid(i).gr_name)):
        with open(f"{folder}/{column}.txt", "w", encoding="utf-8") as f:
            for (i,) in records.select(column).distinct().orderBy(column).toLocalIterator():
                try:
                    name = name_of(i)
                except (KeyError, OverflowError):
                    name = "UNKNOWN"
                f.write(f"{i} {name}\n")


def delete(records: DataFrame, a: argparse.Namespace) -> int:
    """Lists what a retention rule would delete or, with --execute, deletes it and the directories it empties.
    Exit 3 if the question is not answered with YES, 130 if interrupted, 1 after errors."""
    from fathom.operators import retention

    now = int(time.time())
    rule = (a.root, a.basis, a.days, now)
    totals = retention.summary(records, *rule).first().asDict()
    found = retention.candidates(records, *rule)
    if not a.execute:
        print(key_values(totals), end="")
        for r in found.select("path").toLocalIterator():
            print(r.path)
        return 0
    try:
        if not a.force and input(f"Delete {totals['would_delete']} files below {a.root}? Type YES: ").strip() != "YES":
            return 3
        outcomes = {r.outcome: r["count"] for r in retention.remove(found, a.basis, a.days, now).groupBy("outcome").count().collect()}
        removed, failed = retention.remove_directories(retention.empty_directories(records, *rule))
    except EOFError:
        return 3
    except KeyboardInterrupt:
        return 130
    errors = outcomes.get("error", 0) + failed
    print(key_values(totals | {"deleted_files": outcomes.get("deleted", 0), "kept_files": outcomes.get("kept", 0), "removed_empty_dirs": removed, "errors": errors}), end="")
    return int(errors > 0)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl")
    c.add_argument("start"), c.add_argument("out", nargs="?"), c.add_argument("--record-root"), c.add_argument("--shards", type=int, default=UID_SHARDS)
    c.add_argument("--no-write", action="store_true")
    c = sub.add_parser("report")
    c.add_argument("dirs", nargs="+", help="crawls, as Parquet or as packed shards"), c.add_argument("--uid", type=owner, help="an id or a login name"), c.add_argument("--basis", choices=BASES, default="effective")
    c.add_argument("--bucket-details", type=int, default=0), c.add_argument("--report-dir"), c.add_argument("--now", type=int)
    c = sub.add_parser("index")
    c.add_argument("dirs", nargs="*"), c.add_argument("--index-dir", default="./index"), c.add_argument("--uid", type=owner)
    c.add_argument("--resume", action="store_true", help="make the postings from a list of paths that is written already")
    c = sub.add_parser("search")
    c.add_argument("term"), c.add_argument("--index-dir", default="./index"), c.add_argument("--json", action="store_true"), c.add_argument("--skip", type=int, default=0), c.add_argument("--limit", type=int, default=50)
    c = sub.add_parser("repair")
    c.add_argument("dir"), c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("delete")
    c.add_argument("dir", help="a crawl"), c.add_argument("root"), c.add_argument("--basis", choices=BASES[:3]), c.add_argument("--days", type=int, default=0)
    c.add_argument("--execute", action="store_true", help="delete, after a question; without it paths are listed"), c.add_argument("--force", action="store_true", help="do not ask")
    c = sub.add_parser("serve")
    c.add_argument("root"), c.add_argument("--index-dir"), c.add_argument("--bind", default="127.0.0.1"), c.add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from fathom.functions.paths import rewritten
    from fathom.operators import summary
    from fathom.operators.repair import repair, unready
    from fathom.operators.search import PathIndex
    from fathom.render import write_report
    from fathom.sources.layout import write_records
    from fathom.sources.manifest import default_folder, manifest_text
    from fathom.sources.tree import crawl

    spark = session()
    if a.command == "crawl":
        started, errors = time.time(), spark.sparkContext.accumulator(0)
        a.out = a.out or default_folder(os.uname().nodename, started)
        records = crawl(spark, os.path.realpath(a.start), errors=errors)
        if a.record_root:
            records = records.withColumn("path", rewritten(F.col("path"), os.path.realpath(a.start), a.record_root))
        if not a.no_write:
            write_records(records, f"{a.out}/records", a.shards)
            with open(f"{a.out}/crawl_manifest.txt", "w") as f:
                f.write(manifest_text(os.path.realpath(a.start), a.shards, started, time.time(), a.record_root))
            records = spark.read.parquet(f"{a.out}/records")
            write_names(records, a.out)
        totals = summary.crawl_totals(records).first().asDict()
        print(key_values(totals | {"errors": errors.value}), end="")
    elif a.command == "index" and a.resume:
        print(key_values({"mode": "resume"} | PathIndex.resume(spark, a.index_dir).meta()), end="")
    elif a.command in ("report", "index"):
        if not a.dirs:
            parser().error("no crawl to read")
        records = read_crawls(spark, a.dirs)
        if a.command == "report":
            folder = a.report_dir or (f"./{a.uid}" if a.uid is not None else "./all_users")
            print(key_values(write_report(records, folder, a.now or int(time.time()), a.basis, a.bucket_details, a.uid)), end="")
        else:
            mine = records if a.uid is None else records.where(F.col("uid") == a.uid)
            print(key_values(PathIndex.build(mine, a.index_dir).meta()), end="")
    elif a.command == "search":
        index = PathIndex(spark, a.index_dir)
        try:
            if a.json:
                print(index.answer(a.term, a.skip, a.limit))
            else:  # plain lines know no limit
                for r in index.search(a.term).orderBy("path_id").offset(a.skip).toLocalIterator():
                    print(r.path)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    elif a.command == "repair":
        done = repair(spark, a.dir, a.dry_run)
        print(key_values({r["name"]: r["error"] or r["status"] for r in done}), end="")
        if a.dry_run:
            return int(any(r["status"] == "quarantine" for r in done))
        left = unready(spark, a.dir)
        print(key_values({"not_ready": len(left)}), end="")
        return int(bool(left) or any(r["status"] == "quarantine" or r["error"] for r in done))
    elif a.command == "delete":
        return delete(read_crawls(spark, [a.dir]), a)
    elif a.command == "serve":
        from fathom.serve import serve

        serve(a.root, PathIndex(spark, a.index_dir) if a.index_dir else None, a.bind, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
