import pytest

#: Rows that every operator must bear: nulls, empty, white space, repeated rows, ties, other scripts, long, and columns with clashing names.
TEXTS = [
    (1, "the cat sat on the mat and the dog sat on the log today", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \n\t ", None),
    (5, "the cat sat on the mat and the dog sat on the log today", "en"),
    (5, "the cat sat on the mat and the dog sat on the log today", "en"),
    (6, "der hund und die katze sind nicht im haus sondern auf der strasse", "de"),
    (7, "日本語のテキスト 123 !!", "ja"),
    (8, "word " * 30_000, "en"),
    (None, "no id at all in this row of text", "en"),
    (9, "a" * 20_000, None),
    (10, "one two", "en"),
]


@pytest.fixture
def odd(spark):
    """doc_id, text, lang and columns whose names operators use themselves."""
    rows = [(i, t, g, 0.5, 7, "x", [1]) for i, t, g in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, length int, feature string, ids array<int>").repartition(3)


@pytest.fixture
def empty(odd):
    return odd.where("false")
