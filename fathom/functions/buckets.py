"""Column expressions: time basis, age and size buckets, change-led files.

Times are epoch seconds of an unsigned type: a negative value stands for a huge one, so it is later than any
other and, like every future time, of age bucket 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.schema import AGE_BOUNDS_DAYS, BADGE_PERCENT, BASES, CHANGE_LED_SECONDS, DAY, SIZE_BOUNDS


def basis_time(basis: str) -> Column:
    """The time that a report goes by; effective: the latest of the three. -1 stands for any wrapped time."""
    if basis not in BASES:
        raise ValueError(f"basis must be one of {BASES}")
    if basis != "effective":
        return F.when(F.col(basis) < 0, F.lit(-1)).otherwise(F.col(basis)).cast("long")
    return F.when(F.least("atime", "mtime", "ctime") < 0, F.lit(-1)).otherwise(F.greatest("atime", "mtime", "ctime")).cast("long")


def stepped(value: Column, bounds: list[int]) -> Column:
    """How many bounds the value has reached."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value < bounds[i], F.lit(i)).otherwise(out)
    return out.cast("int")


def size_bucket(size: Column) -> Column:
    return stepped(size, SIZE_BOUNDS)


def age_bucket(ts: Column, now: int) -> Column:
    """Whole days before now; unknown (0), wrapped and future times are of bucket 0."""
    days = F.floor((F.lit(now) - ts) / DAY)
    return F.when((ts <= 0) | (ts > now), F.lit(0)).otherwise(stepped(days, AGE_BOUNDS_DAYS)).cast("int")


def change_led() -> Column:
    """Whether ctime is at least 180 days after both other times (compared as unsigned)."""
    a, m, c = F.col("atime"), F.col("mtime"), F.col("ctime")
    wrapped = F.greatest(F.when(a < 0, a), F.when(m < 0, m))
    return (
        F.when((c < 0) & wrapped.isNull(), F.lit(True))
        .when(wrapped.isNotNull(), (c < 0) & (c - wrapped >= CHANGE_LED_SECONDS))
        .otherwise(c - F.greatest(a, m) >= CHANGE_LED_SECONDS)
    )


def badge_visible(led: Column, total: Column) -> Column:
    return (total > 0) & (led > 0) & (led.cast("decimal(38,0)") * 100 >= total.cast("decimal(38,0)") * BADGE_PERCENT)


def uid_shard(uid: Column, shards: int) -> Column:
    """shards is a power of two, so the lowest bits decide."""
    return uid.bitwiseAND(F.lit(shards - 1)).cast("long")
