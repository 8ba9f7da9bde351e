import random

import pytest


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    from fleetpulse.llm.common import prepare

    prepare(spark)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Frame of documents from texts, or (doc_id, text) pairs, with the table's other columns."""

    def make(rows, **extra):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def prose():
    """Random words of a small vocabulary; ``rare`` makes nearly all of them unique."""

    def make(n, seed=0, rare=False):
        r = random.Random(seed)
        return [("w%d" % r.randrange(10**9 if rare else 60)) for _ in range(n)]

    return make


def rows(df):
    return [tuple(r) for r in df.collect()]
