import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

LONG = " ".join(f"Wort{i % 977} étrange" for i in range(30_000))
SHARED = "\n".join(["The same Line.", "  the same line. "])


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, null and empty texts, a very long text, repeated rows, one id with two texts, marks only."""
    texts = ["", None, "x", "!!! ???", LONG, "one two three four five six seven", "One, two; THREE four five six seven", "\n\n\n", "naïve 😀 text\r\nwith lines\t", f"{SHARED}\nown line"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 2 else "s", 0) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (6, "another text under one id", "de", "s", 0), (None, "a text without an id", "en", "s", 0), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Those rows with further columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    from pyspark.sql import functions as F

    clash = ["score", "hits", "spans", "items", "ids", "n_words", "kept", "parts", "lang_pred", "margin", "rejected"]
    return spark.createDataFrame(odd_rows, schema).withColumns({c: F.lit("own") for c in clash})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
