import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 4), (4, LONG, "en", None, 9), (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7),
        (5, "another text with the same id and a few more words", "fr", "b", 1), (None, "no id here but some words all the same", "fr", None, 3), (None, None, None, None, None),
        (8, LONG, "en", "a", 9), (9, "é\u00a0ü 😀 <|endoftext|> x", "de", "c", 3), (10, "a" * 5000, "de", "c", 5000),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] or "" for r in rows}
