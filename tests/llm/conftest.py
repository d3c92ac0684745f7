import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns with names of results."""
    rows = [
        (1, None, "x", 0), (2, "", None, 1), (3, "Hello  World.\n a \tb ", "x", 2), (3, "Hello  World.\n a \tb ", "x", 2),
        (4, LONG, "y", None), (5, "x" * 50_000, "y", 5), (6, " \n ", "y", 6), (7, "Released under the MIT License.", "z", 7), (None, "no id here", "z", 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, start int")
