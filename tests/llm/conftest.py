import pytest

LONG = "word " * 40_000 + "end"
# (doc_id, text, lang, source, n_chars, id, plain): repeated rows, ties, nulls, empty and long texts,
# and columns with names that the operators use inside.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog today", "en", "a", 1, 9, "x"),
    (2, "The quick brown  fox jumps over\tthe lazy dog today", "en", "b", None, 8, None),
    (3, "The quick brown fox jumps over the lazy dog today", None, None, 3, None, "y"),
    (3, "The quick brown fox jumps over the lazy dog today", None, None, 3, None, "y"),
    (4, "", "en", "a", 0, 1, "z"),
    (5, None, "de", "c", None, 1, "z"),
    (6, "   \n\t ", "de", "c", 6, 1, "z"),
    (7, LONG, "en", "a", 7, 1, "z"),
    (8, "Ünïcödé <|endoftext|> test ☃ 日本語 ﬁ Σίσυφος ÉÉ <0x0A> it's we'll 12345", "fr", "d", 8, 1, "z"),
    (9, "one", "fr", "d", 9, 1, "z"),
    (10, "one two", "fr", "b", 10, 1, "z"),
    (None, "a row without an id\nReleased under the MIT License.\n", "en", "a", 11, 1, "z"),
    (12, "x\x01y\r\n\x0b\x0cz ▁▁ marks  two   spaces ", "en", "é", 12, 1, "z"),
    (13, "ONE  TWO", "en", "b", 13, 1, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, plain string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, "lang").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def as_text(text):
    return "" if text is None else text
