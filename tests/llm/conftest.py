import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case: nulls in all columns, empty and blank texts, ties, repeated rows, a very long text, and extra columns."""
    text = "the quick brown fox jumps over the lazy dog and then runs away from the angry bear in the dark forest near the old mill"
    rows = [
        (1, text, "en", "a"), (2, text, "en", "a"), (3, text + " today", "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, " \t\r\n ", "de", "b"), (7, "one", "fr", "c"), (7, "one", "fr", "c"), (None, text, "en", "a"),
        (8, "word " * 60_000 + text, "en", None), (9, "Été ÉTÉ été " * 30, "fr", "c"), (10, "\n\n" + "All rights reserved.\nReleased under the MIT License.\nCC BY cc by", "en", "a"), (11, "x" * 300, "en", "b"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ["doc", "row", "term", "n", "key", "line", "hub", "g", "spans", "kept", "size", "target", "depth", "h", "bytes", "prefix", "quality", "id"]
    return d.select("*", *[F.lit("x").alias(c) for c in extra])


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
