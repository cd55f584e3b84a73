"""Small awkward inputs that all operators of the package must bear."""

import pytest

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i}" for i in range(60_000))

TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "two words"), (6, "a b c d e"), (7, "A  b\tc\nd e"), (7, "a b c d e"),
         (8, "1234 5678 !!"), (9, LONG), (10, LONG + " end"), (11, "Straße naïve 日本語 😀 \x00 ▁ <s>"), (None, "no id here at all"),
         (12, "a b c d e"), (12, "a b c d e")]
CLASHES = ("kept", "component_id", "_id", "_text", "vid", "n", "keep", "text_sha256", "_language", "_quality", "_salt", "Score")


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, blank, short, very long, equal and repeated texts, a null id, and columns with taken names."""
    rows = [(i, t, "en", "src", len(t or "")) for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])
