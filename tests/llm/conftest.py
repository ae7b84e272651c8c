import pytest

LINES = ("The mill by the river was built of grey stone and it turned slowly all day.\n"
         "Nobody had counted the sacks that left it since the flood of that year.")


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        n = len(schema.split(", "))
        return spark.createDataFrame([tuple(r) + (None,) * (n - len(r)) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in every column, empty and very long texts, ties, repeated rows and a column with a clashing name."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, LINES, "en", "a", 10), (1, LINES, "en", "a", 10), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, long, "en", "b", len(long)), (5, long + " end", "en", "b", None), (None, LINES, "en", "a", 5), (6, " \n \t\n", "de", None, 4),
            (7, LINES + "\n" + LINES, "fr", "c", 9), (8, "x", "en", "c", 1)]
    return frame([r + (7, "key") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_removed int, key string")


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])


@pytest.fixture(scope="session")
def labels(frame):
    return frame([], "doc_id long, quality int, toxic int")
