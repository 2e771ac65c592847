import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, n string, size string, node string, sig string, class string, f string, y string, ids string, copies string, rule string, text_sha256 string, media string, src string, score string, fold string, label string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "same text here for all", "en", "a"), (2, "same  text here for\tall", "en", "a"), (2, "same  text here for\tall", "en", "a"),
        (3, None, "en", "b"), (4, "", None, None), (5, " \t\n", "en", "b"), (None, "a row without an id", "de", "b"), (None, None, None, None),
        (6, LONG, "en", "a"), (7, LONG + "x", "en", "c"), (8, "ünï çødé 日本 😀 word", "fr", "c"), (9, "word", "en", "c"), (10, "SAME TEXT HERE FOR ALL", "en", "d"),
        (2**53, "x" * 50_000, "en", "d"), (-4, "e" * 30 + " " + "0123456789abcdef" * 3, "en", "é"),
    ]
    return spark.createDataFrame([(*r, None, *["7"][:0], 0, *["z"] * 16) for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
