"""Reports as HTML and as key=value lines. Only bounded tables come to the driver."""

from __future__ import annotations

import os
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.formats import commas, human_bytes, led_label, pretty_count
from fathom.operators import heatmap, rollup, summary
from fathom.schema import AGE_LABELS, SIZE_LABELS

STYLE = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{padding:.4em .8em;border:1px solid #ccc;text-align:right}"


def page(title: str, body: str) -> str:
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>\n'


def report_html(records: DataFrame, now: int, basis: str = "effective", title: str = "Storage report") -> str:
    grid = heatmap.cells(records, now, basis).cache()
    shown = heatmap.shares(heatmap.dense(grid)).select("age_bucket", "size_bucket", human_bytes(F.col("bytes")).alias("b"), commas(F.col("files")).alias("f"), "files_colour", "bytes_colour", led_label(F.col("led_bytes"), F.col("bytes")).alias("led"))
    cell = {(r.age_bucket, r.size_bucket): r for r in shown.collect()}
    sums = {(r.age_bucket, r.size_bucket): r for r in heatmap.margins(grid).select("age_bucket", "size_bucket", human_bytes(F.col("bytes")).alias("b"), commas(F.col("files")).alias("f")).collect()}
    grid.unpersist()
    margin = lambda a, s: f"<th>{sums[a, s].b}<br>{sums[a, s].f}</th>" if (a, s) in sums else "<th>0</th>"
    rows = ["<tr><th></th>" + "".join(f"<th>{escape(x)}</th>" for x in SIZE_LABELS) + "<th>all</th></tr>"]
    for a, label in enumerate(AGE_LABELS):
        tds = "".join(f'<td style="background:linear-gradient(135deg,{r.bytes_colour} 50%,{r.files_colour} 50%)"><a href="bucket_a{a}_s{s}.html">{r.b}</a><br>{r.f}<br><small>{escape(r.led)}</small></td>' for s in range(len(SIZE_LABELS)) for r in [cell[a, s]])
        rows.append(f"<tr><th>{escape(label)}</th>{tds}{margin(a, -1)}</tr>")
    rows.append("<tr><th>all</th>" + "".join(margin(-1, s) for s in range(len(SIZE_LABELS))) + margin(-1, -1) + "</tr>")
    stats = summary.totals(records).first().asDict()
    cards = "".join(f"<dt>{escape(k)}</dt><dd>{v:,}</dd>" for k, v in stats.items())
    return page(title, f"<table>{''.join(rows)}</table><dl>{cards}</dl>")


def bucket_pages(records: DataFrame, now: int, basis: str, levels: int) -> dict[str, str]:
    """File name -> page for all 36 cells; stubs where levels is 0 or a cell is empty."""
    pages = {f"bucket_a{a}_s{s}.html": page(f"{AGE_LABELS[a]}, {SIZE_LABELS[s]}", "<p>No details.</p>") for a in range(6) for s in range(6)}
    if not levels:
        return pages
    shown = rollup.top_rows(rollup.rollup(records, now, basis, levels)).withColumns({"b": human_bytes(F.col("bucket_bytes")), "f": pretty_count(F.col("bucket_files")), "t": human_bytes(F.col("total_bytes"))})
    by: dict[tuple[int, int], list] = {}
    for r in shown.orderBy("age_bucket", "size_bucket", "level", "rank").collect():  # at most 200 rows a level and cell
        by.setdefault((r.age_bucket, r.size_bucket), []).append(r)
    for (a, s), rows in by.items():
        body = "".join(f"<tr><td>{r.level}</td><td style='text-align:left'>{escape(r.row_path)}</td><td>{r.b}</td><td>{r.f}</td><td>{r.t}</td><td>{r.total_files:,}</td><td>{r.total_dirs:,}</td></tr>" for r in rows)
        pages[f"bucket_a{a}_s{s}.html"] = page(f"{AGE_LABELS[a]}, {SIZE_LABELS[s]}", f"<table><tr><th>level</th><th>path</th><th>bytes</th><th>files</th><th>all bytes</th><th>all files</th><th>all directories</th></tr>{body}</table>")
    return pages


def write_report(records: DataFrame, folder: str, now: int, basis: str = "effective", levels: int = 0, uid: int | None = None) -> dict:
    """Writes the pages, of one owner if uid is given; returns the totals, with all records as scanned."""
    os.makedirs(folder, exist_ok=True)
    mine = records if uid is None else records.where(F.col("uid") == uid)
    for name, text in ({"index.html": report_html(mine, now, basis)} | bucket_pages(mine, now, basis, levels)).items():
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    return summary.totals(records, uid).first().asDict()


def key_values(row: dict) -> str:
    return "".join(f"{k}={v}\n" for k, v in row.items())
