import pytest

LONG = "The reeds of the river bend. " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names that operators use themselves."""
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", 1), (2, "", "en", None, 2), (3, LONG, "en", "a", 3), (3, LONG, "en", "a", 3),
        (4, "  \n\t ", "de", "b", None), (5, "Der Fluss fließt und die Weiden stehen. " * 30, "de", "b", 4), (6, "Der Fluss fließt und die Weiden stehen. " * 30, None, "b", 4),
        (7, "!!! 123 ...", "de", None, 4), (None, "no id but a text", "en", "a", 9), (8, "\U0001f600 é x <|endoftext|> y", "en", "c", 1), (8, "\U0001f600 é x <|endoftext|> y", "en", "c", 1),
    ]
    names = ("__key", "__id", "__text", "__row", "__uid", "__salt", "__value", "h", "fp", "root", "best", "kept", "n_words", "word_chars", "text_sha256", "content", "id", "held_out", "start", "length")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
