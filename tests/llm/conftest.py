import random

import pytest

WORDS = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "naïve", "straße", "the", "of", "año", "x1", "y,", "end."]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) * (rng.random() < 0.7) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, white space of all kinds."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 300).split(" ")
    near = [" ".join(w if rng.random() > 0.01 else "changed" for w in base) for _ in range(12)]
    texts = [None, "", "one", "ONE", " one\t", "two words", "two  words", long, long, " ".join(base), *near, prose(rng, 80), "\n\n  \n", "a b   c", "x" * 5000, "same " * 500, "same " * 499]
    texts += [prose(rng, rng.randint(1, 60)) for _ in range(30)]
    rows = [(i * 3, t, "en", "src", 1) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "no id " * 30, "en", "src", None), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use themselves.
CLASHES = {"score": 1, "block": 2, "bucket": 3, "rid": 4, "n": 5, "length": 6, "component_id": 7, "part": 8}


@pytest.fixture(scope="session")
def docs(spark, odd_rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, DOCS).withColumns({k: F.lit(v) for k, v in CLASHES.items()}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
