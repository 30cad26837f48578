import random

import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents with a clashing extra column or two."""
    def run(rows, partitions=3):
        full = [(i, t, "en", "s", len(t or ""), i, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n long, hash string").repartition(partitions)

    return run


@pytest.fixture()
def rnd():
    return random.Random(11)


def words(rnd, n, vocabulary=300):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))
