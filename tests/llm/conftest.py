import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, an extra column."""
    rows = [(1, None, "x"), (2, "", None), (3, "one", "x"), (4, "one two", "y"), (5, "  \t\n ", "y"), (6, "word " * 20_000, None), (7, "same text as the other row", "z"), (7, "same text as the other row", "z"), (8, "1 2 3 ... !!!", "z"), (None, "no id here", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, kind string")
