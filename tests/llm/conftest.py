import pytest

#: Rows that every operator on documents must take: nulls in any column, empty and long texts, ties, repeats, clashing names.
LONG = "lang word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    rows = [
        (1, "Alpha beta gamma delta.", "en", "s", 23, "x", 1, 1),
        (2, "Alpha  beta\tgamma delta.", "en", None, None, None, 2, 2),
        (2, "Alpha  beta\tgamma delta.", "en", None, None, None, 2, 2),
        (None, None, None, None, None, None, None, None),
        (None, "no id here at all", "fr", "s", 17, "y", 3, 3),
        (5, "", "de", "s", 0, "z", 4, 4),
        (6, " \n ", "de", "s", 3, "z", 4, 4),
        (7, LONG, "en", "s", len(LONG), "w", 5, 5),
        (8, "12 34 %%% ###", "en", "s", 13, "w", 5, 5),
        (9, None, "es", "s", None, None, None, None),
        (10, "☃ ▁ naïve Größe", "de", "s", 14, "w", 5, 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rule string, kept int, Score int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
