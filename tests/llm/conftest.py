import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import prose  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, held_out string"


def table(spark, rows):
    """Rows of (doc_id, text, source) as documents, with columns whose names clash with those of results."""
    full = [(i, t, "en", s, None if t is None else len(t), -1.0, -1, "clash") for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, white space only, a very long text, repeated rows, null ids and sources, ties."""
    rng = random.Random(7)
    long = prose(rng, 30_000)
    base = prose(rng, 200)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "b"), (5, base, "b"), (5, base, "b"), (6, base, None), (None, base, "a"), (None, None, None), (7, "one", "c"), (8, "é日本 \U0001f600 x" * 40, "c")]
    rows += [(10 + i, prose(rng, 120), "b") for i in range(12)]
    return table(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [(1, "x", "a")]).limit(0)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: table(spark, rows)
