import pytest

MESSY_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, row int, key string, size long, "
                "node string, score double, label int, votes long")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns named like the operators' own."""
    long_text = " ".join(f"word{i * i % 977}" for i in range(60_000))
    rows = [(i, f"a plain text number {i} of some words that differ {i * i} times", "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [(20, None, "en", "s1", None), (21, "", None, "s1", 0), (22, " \t\n", "en", None, 3), (None, "no id here at all", "en", "s2", 5)]
    rows += [(30, long_text, "en", "s0", len(long_text)), (31, "same words in three rows", "en", "s2", 9), (31, "same words in three rows", "en", "s2", 9),
             (32, "same words in three rows", None, None, None), (None, None, None, None, None), (33, "one", "de", "ä", 3)]
    extra = (None, 7, "k", 3, "n", 0.5, 1, 2)
    return spark.createDataFrame([r + extra for r in rows], MESSY_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], MESSY_SCHEMA)
