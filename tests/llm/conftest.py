import pytest

SF = "/root/testdata/sf0.001"
TRICKY = [
    (1, "alpha beta gamma delta epsilon zeta\nalpha beta gamma delta epsilon zeta\nx"),
    (1, "alpha beta gamma delta epsilon zeta\nalpha beta gamma delta epsilon zeta\nx"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "one"),
    (6, "  two  spaces\r\n and\ttabs  nbsp em "),
    (7, "é" * 40 + " \U0001f600 ünï " * 5),
    (8, "word " * 30_000),
    (9, "a" * 50_000),
    (None, "no id here but text enough to be judged by anyone at all"),
    (10, "### ||| $$$ *** &&& %%% <<< >>>\n### ||| $$$ *** &&& %%% <<< >>>"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and long texts, repeated rows, and clashing extra columns."""
    rows = [(i, t, "en", "s", 0, -1, "x", "y") for i, t in TRICKY]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, length long, key string, words string"
    )


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
