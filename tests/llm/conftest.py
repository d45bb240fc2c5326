import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, left long, h long, n_words long, text_md5 string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names operators might use themselves."""

    def make(texts, ids=None, source="s"):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", source, None if t is None else len(t), "r", 1, 2, 3, "m") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, tied and very long texts, with repeats."""
    long = " ".join(f"w{k % 701}x{k % 13}" for k in range(30_000))
    return [None, "", " \t\n", "one", "one", "a b", "a b c", "é ü ß. \x0b Ǆ ﷽ 東京 🙂", long, long, "x " * 500, "it's <|endoftext|> a\x00b"]


@pytest.fixture(scope="session")
def vocabulary():
    from tagtide.llm.queries import vocabulary as path

    return path()
