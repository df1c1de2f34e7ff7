"""Small tables with the awkward rows every operator must survive."""

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """doc_id, text, source and columns whose names clash with those the operators add."""
    long = "word " * 60000 + "end"
    rows = [(1, None, None), (2, "", "a"), (3, "  \n ", None), (4, long, "b"), (5, "same text of six plain words", "a"), (6, "same text of six plain words", "b"), (6, "same text of six plain words", "b"), (None, "no id here but text", "a"), (8, "!!! ???", "c"), (9, "x", "a")]
    return spark.createDataFrame([(i, t, s, "kept", 7, 0.5) for i, t, s in rows], "doc_id long, text string, source string, rule string, size long, score double")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("1 = 0")
