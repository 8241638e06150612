import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASH = "row_key long, sig string, rep long, prefix long, hashes string, n int, bin int, salt int, __cut_id long, cuts string, tokens string, p_toxic double"


def words(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}x" for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and wordless texts, copies, repeated rows, ids with two texts, and a very long text."""
    rng = random.Random(5)
    a, b = words(rng, 120), words(rng, 90)
    return [
        (1, a, "en", "s", len(a)), (2, a, "en", "s", len(a)), (2, a, "en", "s", len(a)), (3, a.replace("w", "W", 1) + " tail", None, None, None),
        (4, None, "en", "s", None), (5, "", "en", "s", 0), (6, " \n\t ", "de", "s", 4), (7, "!!! ???", "de", "s", 7), (None, b, "fr", None, None), (None, a, "fr", "s", 1),
        (8, b, "fr", "s", len(b)), (8, "other words entirely here", "fr", "s", 25), (9, words(rng, 60_000), "en", "s", None), (10, "short", None, "s", 5), (11, "x " * 300, "en", "s", 600), (12, "äöü ñ 漢字 " * 30, "es", "s", 1),
    ]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(messy_rows, SCHEMA)
    return d.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", "))).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
