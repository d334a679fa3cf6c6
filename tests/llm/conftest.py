import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and clashing extra columns."""
    rows = [
        (1, "the cat sat on the mat", "en", "a", 22, "x", True),
        (1, "the cat sat on the mat", "en", "a", 22, "x", True),
        (2, None, None, None, None, None, None),
        (None, "le chat est sur la table", "fr", "b", 24, "y", False),
        (3, "", "en", "a", 0, "z", None),
        (4, " \n\t ", "en", "a", 4, "z", None),
        (5, "word " * 60_000, "en", "a", 300_000, "z", None),
        (6, "Released under the MIT License.", "en", "b", 30, "z", None),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept boolean")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
