import pytest

LONG = "wort " * 30_000 + "ende"

#: id, text, lang, source: nulls anywhere, empty and very long texts, repeated rows and ids, ties.
ROWS = [
    (1, "The cat sat on the mat and the dog ran away from it today.", "en", "a"),
    (2, "The cat sat on the mat and the dog ran away from it today.", "en", "a"),
    (2, "The cat sat on the mat and the dog ran away from it today.", "en", "a"),
    (3, "The cat sat on  the mat\tand the dog ran away from it today.", "en", None),
    (4, None, "en", "b"),
    (5, "", None, "b"),
    (6, " \n\t ", "de", "b"),
    (7, LONG, "de", "b"),
    (8, "Der Hund und die Katze sind heute nicht im Haus gewesen.", "de", "c"),
    (8, "another text under a repeated id, licensed under the GNU General Public License", "en", "c"),
    (9, "12345 $$$ 678", None, "c"),
    (None, "a row without an id says hello to all of the others", "en", "c"),
    (None, "a row without an id says hello to all of the others", "en", None),
    (10, "ünïcödé 日本語 \U0001f600 <s> <|endoftext|> ▁x", None, "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows, with extra columns whose names operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for name in ("size", "key", "digest", "bucket", "label", "n", "score", "kept", "range", "target", "row", "word", "id", "weight", "toxic", "rest", "shingle", "row_number", "copies", "rows", "text_hash", "share", "found", "learns", "_id", "__digest", "__text", "__share", "__copy", "__n", "__rows", "__id", "__gone", "__row"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
