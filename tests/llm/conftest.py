import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"),
    (3, None, "b"),
    (4, "", None),
    (5, "  \t\n\x0b \r\n", "b"),
    (6, "one two", "a"),
    (7, "ONE   Two", "c"),
    (8, "über straße Ünïcödé 😀 " * 3, None),
    (8, "a second text with the id of another row and some more words in it to count", "c"),
    (None, "a row without an id but with text that is long enough to hold fifty bytes", "a"),
    (None, "a row without an id but with text that is long enough to hold fifty bytes", "a"),
    (9, "line\nline\nline\n\nline", "b"),
    (10, "word " * 4000, "a"),
    (11, "x" * 5000, "b"),
    (12, "The quick brown fox jumps over the lazy dog near the old river bank today too", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names the operators use themselves."""
    rows = [(i, t, s, "x", 7, None, "k", 1.5) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string, n int, keys string, lang string, score double").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
