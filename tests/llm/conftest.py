import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source) rows, with columns no operator should trip over."""

    def make(rows):
        rows = [(*r, "en", "s")[:4] if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
        clash = ("size", "target", "taken", "row", "n", "words", "token", "node", "comp", "host", "kept", "score", "tree", "_w", "_t")
        return df.withColumns({c: F.lit("x") for c in clash})

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and repeated ids, null, blank and very long texts, ties."""
    long = " ".join(f"word{i % 997} the of and" for i in range(20_000))
    return [
        (1, "the of and to in " * 30, "en", "a"),
        (1, "the of and to in " * 30, "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n ", "en", None),
        (None, "a text without an id the of and", "en", "b"),
        (5, long, "en", "b"),
        (6, "one", "xx", "b"),
        (7, "ÀÉ ß   \U0001f600 ok", None, "c"),
        (8, "one", "de", "c"),
    ]
