"""Column expressions that print numbers. Halves go to the even digit, computed in whole numbers, as C's
printf does with exact values (Spark's own formatting rounds halves up)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTE_UNITS = ["B", "K", "M", "G", "T", "P"]
COUNT_UNITS = ["", "K", "M", "G", "T", "P", "E"]


def whole(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(38,0)")


def ratio(top: Column, bottom: Column, digits: int) -> Column:
    """top / bottom with `digits` decimals, rounded half to even."""
    scaled = (whole(top) * 10**digits).cast("decimal(38,0)")
    q = F.call_function("div", scaled, whole(bottom)).cast("decimal(38,0)")
    r2 = (scaled - q * whole(bottom)) * 2
    q = (q + F.when((r2 > whole(bottom)) | ((r2 == whole(bottom)) & (q % 2 == 1)), F.lit(1)).otherwise(F.lit(0))).cast("long")
    if not digits:
        return q.cast("string")
    return F.concat(F.call_function("div", q, F.lit(10**digits)).cast("string"), F.lit("."), F.lpad((q % 10**digits).cast("string"), digits, "0"))


def scaled_units(v: Column, step: int, units: list[str], no_decimals_below: bool) -> Column:
    out = None
    for k in range(len(units)):
        d = step**k
        reached = lambda x: v >= x if x < 1 << 63 else F.lit(False)
        s = F.when(reached(100 * d), ratio(v, F.lit(d), 0)).when(reached(10 * d), ratio(v, F.lit(d), 1)).otherwise(ratio(v, F.lit(d), 2))
        if k == 0 and no_decimals_below:
            s = v.cast("string")
        s = F.concat(s, F.lit(units[k]))
        out = s if out is None else F.when(v >= d, s).otherwise(out)
    return out


def human_bytes(v: Column) -> Column:
    """1024-based: no decimals from 100, one from 10, else two."""
    return scaled_units(v, 1024, BYTE_UNITS, False)


def human_count(v: Column) -> Column:
    """1000-based; whole numbers below 1000."""
    return scaled_units(v, 1000, COUNT_UNITS, True)


def short_count(v: Column) -> Column:
    """1000-based; two decimals below 10 and one below 100, at every size."""
    return scaled_units(v, 1000, COUNT_UNITS, False)


def commas(v: Column) -> Column:
    return F.format_number(v, 0)


def rounded_suffix(v: Column) -> Column:
    """(2M), (5B), (1T), halves up; nothing below a million."""
    part = lambda d, u: F.concat(F.lit("("), F.floor((v + d // 2) / d).cast("string"), F.lit(u + ")"))
    return F.when(v < 10**6, F.lit("")).when(v >= 10**12, part(10**12, "T")).when(v >= 10**9, part(10**9, "B")).otherwise(part(10**6, "M"))


def pretty_count(v: Column) -> Column:
    return F.concat_ws(" ", commas(v), F.when(v >= 10**6, rounded_suffix(v)))


def led_label(led: Column, total: Column) -> Column:
    """Share of change-led bytes: 0%, <1%, one decimal below 10, else whole."""
    l, t = whole(led), whole(total)
    return (
        F.when((t == 0) | (l == 0), F.lit("0%")).when(l * 100 < t, F.lit("<1%"))
        .when(l * 10 < t, F.concat(ratio(led * 100, total, 1), F.lit("%"))).otherwise(F.concat(ratio(led * 100, total, 0), F.lit("%")))
    )


def cell_colour(percent: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    t = F.least(F.greatest(percent / 100.0, F.lit(0.0)), F.lit(1.0))
    rgb = [F.floor(F.lit(float(a)) + float(b - a) * t + 0.5).cast("int").cast("string") for a, b in zip(low, high)]
    return F.concat(F.lit("rgb("), F.concat_ws(",", *rgb), F.lit(")"))


# The colour ramps of shares of files (rose) and of bytes (blue).
ROSE = ((248, 244, 238), (245, 214, 214))
BLUE = ((244, 249, 252), (165, 198, 242))


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def duration(sec: Column) -> Column:
    """HH:MM:SS of seconds, rounded half up; nothing is negative."""
    t = F.greatest(F.floor(sec + 0.5), F.lit(0)).cast("long")
    two = lambda x: F.when(x < 10, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat_ws(":", two(F.floor(t / 3600)), two(F.floor(t % 3600 / 60)), two(t % 60))


def safe_name(name: Column) -> Column:
    clean = F.translate(name, "/\\:\t\n\r", "______")
    return F.when(clean == "", F.lit("tmp")).otherwise(clean)


BINARY_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def binary_bytes(v: Column) -> Column:
    """1024-based with a blank before the unit: whole bytes, above them two decimals."""
    out = F.concat(v.cast("string"), F.lit(" B"))
    for k in range(1, len(BINARY_UNITS)):
        out = F.when(v >= 1024**k, F.concat(ratio(v, F.lit(1024**k), 2), F.lit(" " + BINARY_UNITS[k]))).otherwise(out)
    return out


def count_note(files: Column, share: Column, total: Column) -> Column:
    """(12%), from a million on (2M, 12%): a cell's second line; share of total in whole percent."""
    percent = F.concat(F.when(total > 0, ratio(share * 100, F.greatest(total, F.lit(1)), 0)).otherwise(F.lit("0")), F.lit("%)"))
    return F.when(files >= 10**6, F.concat(F.regexp_replace(rounded_suffix(files), r"\)$", ", "), percent)).otherwise(F.concat(F.lit("("), percent))


def rough_duration(tenths: Column) -> Column:
    """Tenths of a second as s, min, h or days."""
    t = F.greatest(tenths, F.lit(0)).cast("long")
    return (
        F.when(t < 600, F.concat(ratio(t, F.lit(10), 1), F.lit(" s"))).when(t < 36000, F.concat(ratio(t, F.lit(600), 1), F.lit(" min")))
        .when(t < 864000, F.concat(ratio(t, F.lit(36000), 2), F.lit(" h"))).otherwise(F.concat(ratio(t, F.lit(864000), 2), F.lit(" days")))
    )


def wall_clock(ts: Column) -> Column:
    """Epoch seconds as a date and time of the session's zone, with its name."""
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss zzz")
