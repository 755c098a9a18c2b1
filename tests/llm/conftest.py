import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    rows = [
        (5, "one two  three\tfour five six", "en", "b", 1, "r", "x"),
        (3, "one two three four five six", "en", "a", 2, "r", "x"),
        (3, "one two three four five six", "en", "a", 2, "r", "x"),
        (9, "One Two Three Four Five Six", None, "a", 2, None, None),
        (1, None, "de", None, None, None, None),
        (2, "", "de", None, 0, "r", "x"),
        (None, "one two three four five six", "en", "a", 3, "r", "x"),
        (None, None, None, None, None, None, None),
        (7, " \n\t ", "en", "c", 4, "r", "x"),
        (8, "word " * 30000, "en", "c", 5, "r", "x"),
        (10, "x" * 50000, "en", "c", 5, "r", "x"),
        (11, "mail a.b@c.de or 1.2.3.4, +1 (212) 555-0100, 4111 1111 1111 1111; 999.1.1.1 \U0001f600 z@y.org", "en", "b", 6, "r", "x"),
        (12, "two words", "es", "b", 6, "r", "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
