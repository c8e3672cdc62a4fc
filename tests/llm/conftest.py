import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    """Rows that are awkward: nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = "word " * 30_000 + "\nend"
    rows = [(1, "The quick brown fox\njumps over\n\nThe dog", "en", "a", 5), (2, "The quick brown fox\njumps over\n\nThe dog", "en", "b", 5), (3, None, None, None, None), (4, "", "en", "a", 0), (4, "", "en", "a", 0), (5, "   \t\n ", "de", "a", 6), (None, "no id here", "en", "c", 10), (6, long, "en", "b", len(long)), (7, "THE QUICK brown FOX\nother", "en", "é", 25), (8, "naïve —   über\r\nx\x0by", "de", "𐀀", 18)]
    extra = [(*r, f"k{i}", i, "x") for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, key string, node long, h1 string")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
