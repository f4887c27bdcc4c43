"""Column expressions over path strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    """Only A-Z change; other bytes stay."""
    return F.translate(s, UPPER, LOWER)


def under(path: Column, root: Column) -> Column:
    """Whether path is root or below it; an empty root has everything, "/" every absolute path."""
    return F.when(root == "", F.lit(True)).when(root == "/", path.startswith("/")).otherwise((path == root) | path.startswith(F.concat(root, F.lit("/"))))


def rewritten(path: Column, root: str, shown: str) -> Column:
    """Paths at or below root as if root were `shown`; others stay as they are."""
    root, shown = root.rstrip("/") or "/", shown.rstrip("/") or "/"
    tail = path.substr(F.lit(len(root) + 1 if root != "/" else 1), F.length(path))
    return F.when(path == root, F.lit(shown)).when(path.startswith(root if root == "/" else root + "/"), F.concat(F.lit(shown if shown != "/" else ""), tail)).otherwise(path)


def components(path: Column) -> Column:
    """Names along the path; repeated slashes count once."""
    return F.filter(F.split(path, "/"), lambda c: c != "")


def ancestors(path: Column) -> Column:
    """The path's own names joined from the root, at every depth, itself included."""
    names = components(path)
    return F.transform(F.when(F.size(names) > 0, F.sequence(F.lit(1), F.size(names))).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(names, F.lit(1), k), "/")))


def parent(path: Column) -> Column:
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def last_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def slashes(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("long")


def below(path: Column, base: Column) -> Column:
    """What follows base in a path under it."""
    return F.when(base == "", path).when(base == "/", path.substr(F.lit(2), F.length(path))).otherwise(path.substr(F.length(base) + 2, F.length(path)))


def level_rows(names: Column, base: Column, levels: int) -> Column:
    """(level, row_path) for the first `levels` of the names that a path has below base, file names included."""
    lead = F.when(base.isin("", "/"), base).otherwise(F.concat(base, F.lit("/")))
    return F.transform(steps(F.lit(1), F.least(F.size(names), F.lit(levels))), lambda k: F.struct(k.alias("level"), F.concat(lead, F.array_join(F.slice(names, F.lit(1), k), "/")).alias("row_path")))


def steps(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def leads(names: Column, low: Column, high: Column) -> Column:
    """The first low to high of a path's names joined from the root, as far as it has them."""
    return F.transform(steps(low, F.least(F.size(names), high)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(names, F.lit(1), k), "/")))


def trigrams(text: Column) -> Column:
    """Distinct 3-byte windows without a slash, as 24-bit numbers, of a lower-cased string."""
    signs = F.decode(F.encode(ascii_lower(text), "UTF-8"), "ISO-8859-1")  # a character for each byte
    windows = F.array_distinct(F.regexp_extract_all(signs, F.lit("(?=([^/]{3}))"), 1))
    return F.transform(windows, lambda g: F.ascii(g) * 65536 + F.ascii(F.substring(g, F.lit(2), F.lit(1))) * 256 + F.ascii(F.substring(g, F.lit(3), F.lit(1))))


def path_trigrams(path: Column) -> Column:
    """Distinct 3-byte windows inside the names of a path, ascending; no window crosses a slash."""
    return F.array_sort(trigrams(path))


#: Characters of a path's lead that tables show.
SHOWN = 28


def shown_lead(path: Column, base: Column, level: int) -> Column:
    """What stands before a path's last name in a table: the lead itself if it is short, else its last names
    after ".../". From level 2 on the base is left out as "..."."""
    lead = F.regexp_replace(path, "[^/]*$", "")

    def tail(s: Column) -> Column:
        cut = F.length(s) - SHOWN  # whole names only: on from the last slash before the cut
        head = F.when(cut > 0, s.substr(F.lit(1), cut)).otherwise(F.lit(""))
        start = F.length(F.regexp_extract(head, "^(.*/)?", 0))
        return F.concat(F.lit(".../"), s.substr(start + 1, F.length(s)))

    plain = F.when(F.length(lead) <= SHOWN, lead).otherwise(tail(lead))
    if level < 2:
        return plain
    rest = lead.substr(F.length(base) + 1, F.length(lead))
    inside = (base != "") & path.startswith(base) & ((path.substr(F.length(base) + 1, F.lit(1)) == "/") | (F.length(base) == F.length(lead)))
    return F.when(~inside, plain).when(rest.isin("", "/"), F.lit(".../")).when(F.length(rest) <= SHOWN, F.concat(F.lit("..."), rest)).otherwise(tail(rest))
