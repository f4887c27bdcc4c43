"""What the vector operators share: usable rows and k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need


def fine(column: str):
    """Whether a vector is there, has only finite components and is not zero."""
    x = F.col(column)
    held = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(held, F.lit(False))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, vec: rows whose vector is fine(). Shorter vectors count as if zeros followed."""
    return need(vectors, "vec_id", column).where(fine(column)).select("vec_id", F.col(column).cast("array<double>").alias("vec"))


def matrix(rows, width: int) -> np.ndarray:
    """Lists of numbers as rows of one matrix."""
    if all(len(r) == width for r in rows):
        return np.array(rows, np.float64).reshape(-1, width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms of the rows, for huge and tiny components too."""
    scale = np.abs(x).max(1, initial=1e-300)
    return scale * np.sqrt(((x / scale[:, None]) ** 2).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares of huge or tiny components neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """k centres (fewer only for fewer rows), from random rows; an empty centre takes the worst-placed row."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = squared(x, centres)
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            worst = np.argsort(-d[np.arange(len(x)), near], kind="stable")[: int((n == 0).sum())]
            centres[n == 0] = x[worst]
    return centres


def sample_of(rows: DataFrame, most: int, width: int, by: str = "vec_id") -> np.ndarray:
    """At most `most` vectors, picked by a hash: a bounded sample for fitting."""
    return matrix([r.vec for r in rows.select("vec", F.xxhash64(by).alias("h"), by).orderBy("h", by).limit(most).select("vec").collect()], width)
