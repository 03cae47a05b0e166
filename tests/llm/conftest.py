import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ("the cat sat on the mat and looked at the moon while seven small mice ran over the old wooden floor "
         "of the house near the river where nobody had lived for many long years")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rows = [(1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, None, "en", "b", None),
            (4, "", None, None, 0), (5, "   \n\t ", "en", None, 6), (None, "lone words here", "en", "a", 3),
            (7, "x" * 300_000, None, "b", 300_000), (8, "word " * 60_000, "en", "b", 300_000),
            (9, "Der alte Mann schläft über dem Haus und träumt von großen Bäumen", "de", "c", 2),
            (10, "<|endoftext|> 12 !? 漢字 \x1c 😀", None, "c", 3), (11, "!!! ??? 123", "en", "", 11)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with extra columns named like outputs and helpers."""
    names = ["score", "size", "key", "class_id", "n", "rows", "digest", "target", "part", "base", "keys", "spans",
             "x", "label", "draw", "held_out", "bucket", "root", "rate", "copies", "prior"]
    return odd.withColumns({c: F.lit("clash") for c in names})


def as_rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))
