import random

import pytest


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(["the", "an", "er", "on", "ti", "re", "é", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows and a clashing extra column."""
    base = " ".join(words(1, 120)) + "."
    rows = [
        (1, base, "en", "a", 5, "x"),
        (2, base, "en", "a", 5, "x"),
        (2, base, "en", "a", 5, "x"),
        (3, None, "en", "a", None, None),
        (4, "", None, None, 0, "x"),
        (5, " \n\t ", "fr", "b", 3, "x"),
        (6, "one two", "fr", "b", 7, "x"),
        (7, " ".join(words(2, 60_000)), "de", "c", 9, "x"),
        (8, "".join(c.upper() if c.isascii() else c for c in base), "en", "a", 5, "x"),
        (9, base.replace("the", "the ", 2), "en", None, 5, "x"),
        (None, "no id here", None, "a", 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
