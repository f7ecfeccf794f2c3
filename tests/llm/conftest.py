import os

import pyarrow as pa
import pytest


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = os.environ.get("PYTHONPATH", "")
    os.environ["PYTHONPATH"] = f"{root}{os.pathsep}{known}" if known else root


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (id, text) with the usual columns and some whose names clash with results."""

    def build(rows, lang="en"):
        schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, rest int"
        full = [(i, t, lang, "s", None if t is None else len(t), "x", "y", 1) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def arrow():
    return lambda texts: pa.array(texts, pa.string())
