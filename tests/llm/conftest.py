import pytest

from millrace.llm.shipping import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, rows that repeat, and clashing names."""
    long_text = "\n".join(" ".join(f"w{i}x{k}" for k in range(40)) for i in range(400))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "b", 1),
        (2, "the quick brown fox jumps over the lazy dog", "en", "b", 1),
        (2, "the quick brown fox jumps over the lazy dog", "en", "b", 1),
        (2, "another text of the same id\nthe quick brown fox jumps over the lazy dog", None, None, None),
        (3, "", "en", "a", 0),
        (4, None, "en", "a", None),
        (5, " \n\t ", None, "a", 0),
        (None, "a text without an id", "en", None, 3),
        (None, "a text without an id", "en", None, 3),
        (None, None, None, None, None),
        (6, "42 !!! 17", "fr", "c", 1),
        (7, long_text, "fr", "c", 9),
        (8, "été à la plage\n\nété à la plage", "fr", "c", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("_text", "size", "target", "copy", "fp", "key", "__gone", "__row", "n_lines", "block", "at", "_order"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df
