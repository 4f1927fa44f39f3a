import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


LONG = " ".join(f"word{i % 977} and{i % 31}, 12.5" for i in range(12_000)) + ".\nEnd of it."


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and extra columns with names used inside."""
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n \x0b", None, None), (4, LONG, "en", "b"),
        (5, "same text of five words", "en", "b"), (5, "same text of five words", "en", "b"),
        (6, "same text of five words", "de", "c"), (6, "another text under that id", "de", "c"),
        (None, "a row without an id", "fr", "a"), (7, "12345 !!! 678", None, "a"), (8, "x", "en", None),
        (9, "\n\n\n", "en", "a"), (10, "Ünïcödé ñandú 漢字 😀 é", "es", "d"),
    ]
    names = "id bucket component n samples _text text_crc32 key slot lines keys hash score label kept rule _row base".split()
    wide = [(*r, *["extra"] * len(names)) for r in rows]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(wide, schema)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0, "x"), (4, None, None, "x"), (5, 1, 0, "x"), (5, 0, 1, "x"), (None, 1, 1, "x"), (99, 0, 0, "x")],
        "doc_id long, quality int, toxic int, _label string",
    )


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
