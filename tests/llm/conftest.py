import pytest
from invented import prose

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [(1, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (3, None, "en", "b"), (4, "", None, "b"),
            (5, prose(5, 30_000), "en", None), (None, prose(1, 80), "en", "a"), (None, None, None, None), (6, " \n\t ", "de", "c"), (7, "wort", "de", "c"),
            (8, prose(1, 79) + " other", "en", "a"), (9, "١٢٣ 😀 .", "de", "c"), (10, "password = abcdefgh1 user: bob https://x.example.com/a", "en", "a")]
    rows = [(*r, len(r[1]) if r[1] is not None else None, i % 3, "x", 1.5) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, text_key string, node double")


@pytest.fixture(scope="session")
def empty_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
