import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents with an extra column whose name clashes with a result's."""

    def make(rows, extra="pos"):
        return spark.createDataFrame([(i, t, "src" if i is not None and i % 3 else None, 7) for i, t in rows], f"doc_id long, text string, source string, {extra} int")

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded prose of invented words, n words long."""

    def make(n, seed):
        rng = random.Random(seed)
        words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
        return " ".join(rng.choice(words) for _ in range(n))

    return make
