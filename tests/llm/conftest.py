import random
from pathlib import Path

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (id, text) pairs, with extra columns whose names the operators use inside."""

    def make(rows, source=lambda i: "s"):
        full = [(i, t, "en", source(k), None if t is None else len(t), "x", 1) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS + ", salt string, fp int")

    return make


@pytest.fixture(scope="session")
def words():
    return lambda n, seed, of=400: " ".join(random.Random(seed).choices([f"w{i}" for i in range(of)], k=n))


@pytest.fixture(scope="session")
def sample(spark):
    if not Path(SF).exists():
        pytest.skip("the sample tables aren't here")
    return spark.read.parquet(f"{SF}/documents.parquet")
