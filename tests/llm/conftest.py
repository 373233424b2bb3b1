import pytest

#: Rows that try every operator: null and empty texts, repeated rows and ids, ties, blanks only, a very long word.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "One two"), (7, "a b c d e"), (7, "a b c d e"),
    (8, "x" * 5000), (9, "é ü ß. " * 30), (10, "Same line here.\nSame line here.\nother words follow there"), (None, "Same line here.\nand more words"),
    (None, None), (11, "l'été 'tis they're <|endoftext|> 12 ½ 日本 \U0001f600"), (12, "\n\n\n"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", 0, 7, "b", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars long, id long, line string, n double").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").repartition(4).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
