import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept int, size long, node long"
PROSE = (
    "the quick brown fox jumps over the lazy dog and then it runs far away from the big old barn near the river "
    "where many small boats wait for the morning wind to carry them over the quiet water to the other side of town "
    "while the people sleep in their houses and dream of summer days and long walks along the green hills at noon"
)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, blank, short and long texts, ties, repeated rows."""
    words = PROSE.split()
    rows = [
        (1, PROSE, "en", "a", 10, "x", 1, 2, 3),
        (2, PROSE.replace(" ", "\n\t "), "en", "a", 10, "x", 1, 2, 3),
        (3, PROSE.upper(), None, "b", None, None, None, None, None),
        (4, " ".join(words[:-1] + ["night"]), "en", None, 10, "x", 1, 2, 3),
        (5, None, "en", "a", 0, "x", 1, 2, 3),
        (6, "", "de", "a", 0, "x", 1, 2, 3),
        (7, " \n\t ", "de", "a", 0, "x", 1, 2, 3),
        (8, "three short words", "en", "a", 3, "x", 1, 2, 3),
        (8, "three short words", "en", "a", 3, "x", 1, 2, 3),
        (9, "three short words", "en", "a", 3, "x", 1, 2, 3),
        (10, "12 34 !!", "en", "a", 3, "x", 1, 2, 3),
        (11, "word " * 60_000, "en", "a", 3, "x", 1, 2, 3),
        (12, "Unrelated start. " + PROSE + " An end of its own, with ünïcödé ✓.", "en", "a", 3, "x", 1, 2, 3),
        (None, PROSE, "en", "a", 10, "x", 1, 2, 3),
        (None, None, None, None, None, None, None, None, None),
        (-13, "x" * 200_000, "fr", "c", 1, "x", 1, 2, 3),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
