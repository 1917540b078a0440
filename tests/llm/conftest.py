import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, host string, lines int, n_words string, kept string, y int, word string"
LONG = "long words are here and there " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like those of results."""
    rows = [
        (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a"), (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a"), (2, "one two three four five six seven eight nine ten eleven TWELVE", None, "a"),
        (3, None, "en", "b"), (4, "", "en", None), (None, "text of a row without an id, which says little", "en", "b"), (5, LONG, "de", "b"), (6, "\n\n \n", "en", "c"), (7, "...!!!", "en", "c"), (8, "été über ñandú", None, None), (9, "a", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, 0.5, "h", 3, "n", "k", 7, "w") for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1), (1, 1, 0), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
