import pytest

LONG = " ".join(f"w{i % 5000}x{i % 37}" for i in range(60_000))
SAME = "one two three four five six seven eight nine ten eleven twelve"


def messy_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows."""
    return [
        (1, SAME, "en", "a", 5), (1, SAME, "en", "a", 5), (2, SAME, "en", None, 5), (3, None, None, "a", None),
        (4, "", "en", "b", 0), (5, " \t\n\x0b\x0c\r ", "en", "b", 7), (6, LONG, "en", "b", len(LONG)),
        (7, LONG + " end", "en", None, 1), (None, SAME, "en", "c", 1), (None, None, None, None, None),
        (8, "é ü x 12 ß", "de", "\U0001f600", 3), (9, "A b", "en", "c", 3), (10, "a B", "en", "c", 3),
    ]


@pytest.fixture(scope="session")
def messy(spark):
    """The rows with extra columns named like those that operators use inside."""
    base = spark.createDataFrame(messy_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("size", "host", "root", "keys", "score", "spans", "band", "slot", "rate", "place", "bucket", "row", "id",
             "n_rows", "first_id", "fa", "cut", "mean", "kept", "boundary", "of_source", "copies", "content")
    return base.selectExpr("*", *[f"'clash' as `{name}`" for name in extra])


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("false")
