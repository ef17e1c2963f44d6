import pytest

LONG = "word " * 30_000
EDGE_TEXTS = [
    None, "", " \n\t ", "one", "two words", "A plain text of a few words. It ends here.",
    "A plain text of a few words. It ends here.", LONG, "line\nline\nline\n" * 20, "é ñ ü " * 30, "### $$$ | <b>", "\x00 \x1c x",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, ["en", None][i % 2], ["a", None, "b"][i % 3], None if t is None else len(t)) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[5], rows[5], (None, "no id here", None, None, None), (5, "same id, other text", "en", "a", 3), (None, None, None, None, None)]
    clash = [(*r, 1, "x", 2.0, "y", 7) for r in rows]
    return spark.createDataFrame(
        clash, "doc_id long, text string, lang string, source string, n_chars long, "
        "shard int, key string, score double, `group` string, n_words long",
    )


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
