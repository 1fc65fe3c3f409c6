import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_texts import CLASHING, odd_texts  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """odd_texts as documents, with columns whose names the operators use inside."""
    rows = [(i, t, "en", None if i is None or i % 3 == 0 else f"src{i % 2}", 1, *["clash"] * len(CLASHING)) for i, t in odd_texts()]
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{c}` string" for c in CLASHING)]
    return spark.createDataFrame(rows, ", ".join(names)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
