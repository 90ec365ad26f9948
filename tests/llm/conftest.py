import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", ","]) for _ in range(n))


def awkward_rows(seed=1):
    """Nulls in any column, empty and long texts, repeated rows and keys, shared passages, odd characters."""
    rng = random.Random(seed)
    long = prose(rng, 4000)
    passage = prose(rng, 80)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, "   \n\t ", "en", None, 6),
        (4, "one", None, "s", 3),
        (5, long, "en", "s", len(long)),
        (6, long, "en", "s", len(long)),
        (6, long, "en", "s", len(long)),
        (None, "a text without a key, quite short", "en", "s", 30),
        (None, None, None, None, None),
        (7, long[:9000] + " changed " + long[9000:], "en", "t", 1),
        (8, "ä" * 700 + " ñandú 漢字 😀 \x00\x01\x02 " + "ä" * 300, "es", "t", 1),
        (9, "ab " * 600, "en", "t", 1800),
    ]
    for k in range(10, 30):
        rows.append((k, prose(rng, rng.randint(5, 120)) + " " + passage + " " + prose(rng, rng.randint(0, 60)), "en", "hot", None))
    for k in range(30, 45):
        rows.append((k, prose(rng, rng.randint(1, 200)), "en", rng.choice(["s", "t", None]), k))
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
