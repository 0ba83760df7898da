import pytest

#: Rows with nulls in every column, empty and blank texts, repeats, ties, a very long text.
LONG = " ".join(f"word{i % 997} alpha{i % 13}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 10),
    (2, "", "en", "b", 0), (3, None, None, None, None), (None, "der schnelle braune fuchs springt über den faulen hund und läuft weit weg von hier", "de", None, 5),
    (4, "  \n\t ", "de", "", 4), (5, LONG, "en", "a", len(LONG)), (6, "1234 5678 !!!", None, "b", 3), (2, "a second text of the same number here", "en", "c", 7),
    (7, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "b", 10), (8, "x", "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents that try every defined case, with extra columns whose names clash with what operators make."""
    rows = [(*r, "keep", 1, i) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, fp int, `size` int").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
