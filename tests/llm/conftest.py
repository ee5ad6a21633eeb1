import pytest

AWKWARD = ["", None, " ", "\t\n", "a", "é😀", "word " * 50, "x" * 20000, "same text here", "same text here", "same  text\there"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in any column, empty and long texts, repeated rows and clashing column names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 7, "k", 1) for i, t in enumerate(AWKWARD)]
    rows += [rows[8], (None, "no id", "de", "s1", None, None, None), (None, None, None, None, None, None, None), (3, "another text of a repeated id", "en", "s0", 1, "k", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int, base string, size int")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
