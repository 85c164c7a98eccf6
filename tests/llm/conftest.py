import pytest

from tests.conftest import SMALL

#: Nulls in any column, empty, blank, repeated and very long texts, and columns whose names operators use themselves.
ODD = [
    (1, "The same words stand here twice over, as a copy does.", "en", 9, "a"),
    (2, "The same words stand here twice over, as a copy does.", None, 9, "a"),
    (2, "The same words stand here twice over, as a copy does.", None, 9, "a"),
    (3, None, "en", None, None),
    (4, "", "de", 0, ""),
    (5, " \t\n ", "fr", 4, "b"),
    (None, "a row without an id", "en", 19, "c"),
    (6, "ΣΑΣ ŉ İstanbul ﬁ \u0085x y <|endoftext|> 'S don't 123 ½ 日本語", "es", 1, "d"),
    (7, "word " * 60_000, "en", 300_000, "e"),
    (8, "x", None, 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, n_lines int, fp string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return dict(sorted((r.doc_id, r.text) for r in documents.collect()))
