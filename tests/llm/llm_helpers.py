"""Fixtures and helpers of these tests."""

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, a repeated row, and columns that clash with results."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [
        (1, word * 8, "en", "a", 9, "x"),
        (1, word * 8, "en", "a", 9, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, "x"),
        (4, " \n\t ", "de", "a", 4, "x"),
        (None, "no id here", "en", None, 10, "x"),
        (5, "long " * 60_000, "en", "b", 300_000, "x"),
        (6, word * 8, "en", None, 9, "x"),
        (7, "é ß Σ 日本 😀", "fr", "b", 11, "x"),
    ]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def plain(df, *columns):
    """Rows as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
