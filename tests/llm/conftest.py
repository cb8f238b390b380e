import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node string, key string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    long = " ".join(f"word{i % 977} {'x' * (i % 5)}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog by the river bank today.", "en", "a", 5, "s", "n", "k"),
        (2, "The quick brown fox jumps over the lazy dog by the river bank today.", "en", "a", None, None, None, None),
        (3, "THE QUICK brown fox jumps over the lazy dog by the river bank today.\n", "en", "b", 1, "s", "n", "k"),
        (4, None, None, None, None, None, None, None),
        (5, "", "de", "", 0, "", "", ""),
        (6, " \t\n", "de", None, 3, "s", "n", "k"),
        (7, "Der schnelle braune Fuchs springt über den faulen Hund. ÄÖÜ ß!", "de", "b", 1, "s", "n", "k"),
        (7, "Der schnelle braune Fuchs springt über den faulen Hund. ÄÖÜ ß!", "de", "b", 1, "s", "n", "k"),
        (8, long, "en", "c", 1, "s", "n", "k"),
        (9, "one two", "en", "c", 1, "s", "n", "k"),
        (10, "日本語 の テスト  二つ の 空白   🎵🎵", None, "c", 1, "s", "n", "k"),
        (11, "Released under the MIT License. Licensed under the Apache License, Version 2.0.\nMIT License", "en", "d", 1, "s", "n", "k"),
        (None, "a text without an id, of some words", "en", "a", 1, "s", "n", "k"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
