import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{k % 977} other{k % 31}" for k in range(60_000))
    line = "a line that is long enough to be a key of its own, surely"
    texts = [(1, "One two three four five."), (2, None), (None, "no id here at all, sorry"), (4, ""), (5, "   \n\t \n"), (6, long), (7, long), (7, long), (8, line), (9, line), (10, line), (11, f"  {line.upper()}\t"), (12, f"x\n{line}\ny"), (13, "ä" * 50), (14, "!!! ??? ..."), (15, "é ü <|endoftext|> 日本語")]
    rows = [(d, t, None if d in (1, 6) else "en", None if d in (4, 9) else "s", None, d, "clash", 0.5, 1) for d, t in texts]
    return spark.createDataFrame(rows, DOCUMENTS + ", block long, score string, n_lines double, component_id long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
