import random

import pytest
from pyspark.sql import functions as F

# Names that the operators use for columns of their own.
CLASHING = ("size", "place", "copies", "target", "taken", "source_no", "cell", "group", "bucket", "lead", "set", "node", "root", "_row", "score",
            "rejected", "predicted", "base", "last_place", "groups", "fingerprint", "component_id", "held_out", "class")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank, very short and very long texts, copies, ties and repeated rows."""
    base = words(120, 1)
    near = base + " and more"
    return [
        (1, base, "en", "a", 1), (2, near, "en", "a", 1), (3, base, "en", "b", 1), (3, base, "en", "b", 1), (4, None, "fr", "b", None),
        (5, "", None, None, 0), (6, " \t\n ", "de", "c", 4), (7, "one two", "en", "c", 7), (8, "One  TWO", "en", None, 8),
        (9, words(30_000, 2), "en", "a", 1), (10, words(300, 3), None, "d", 1), (11, "Été à la plage, garçon naïf, élève.", "fr", "d", 1),
        (None, "a row without an id", "en", "a", 1), (None, None, None, None, None), (12, "12345 !!! ---", "en", "e", 1),
        (13, "日本語のテキスト です", "ja", "e", 1), (14, "🙂 WARC/1.0\r\nContent-Length: 3\r\n\r\nabc", "en", "e", 1),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use themselves."""
    docs = spark.createDataFrame(odd_rows, DOC_SCHEMA)
    return docs.withColumns({name: F.lit(name) for name in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
