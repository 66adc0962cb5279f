import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from llm_words import ODD  # noqa: E402


@pytest.fixture
def store(spark):
    from chunkloom.llm.shared import Store

    return Store(spark, "test")


@pytest.fixture
def odd(spark):
    """Odd texts, repeated rows, null ids and sources, and columns whose names operators might use themselves."""
    rows = [(i, t, "en", "s1" if i % 3 else None, i) for i, t in enumerate(ODD)]
    rows += [(3, ODD[3], "en", "s1", 3), (None, "a b", "fr", "s2", None), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for name in ("id", "n", "key", "h", "score", "kept", "sha", "component", "at", "__low"):
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df
