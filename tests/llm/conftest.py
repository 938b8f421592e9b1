import pytest

#: Null, empty, white space only, exact copies, a very long text, odd letters, special strings; doc_id tied and null.
TEXTS = [
    (1, "The quick brown fox, jumps over the lazy dog!"), (2, None), (3, ""), (4, "   \n\t "), (5, "The quick brown fox, jumps over the lazy dog!"),
    (6, "word " * 30_000), (7, "İstanbul don't I'll it’s ﬁne ①2 a_b x.y.z <|endoftext|>a ß ẞ É ét 漢字 123"), (7, "the same id again"), (None, "no id"), (9, "a"), (10, "x" * 70_000),
    (11, "Und " * 200 + "a b\x1cc \x85 d"), (12, "Èreaux, les éeux de la ville."),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with every awkward case, and extra columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), -1, "k") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid long, key string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
