import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows; other columns are NULL."""

    def make(*rows):
        return spark.createDataFrame([(*row, *[None] * (5 - len(row))) for row in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def cases(documents):
    """NULLs, empty, blank and very long texts, equal and repeated rows, under columns that clash with results."""
    from pyspark.sql import functions as F

    clashing = ["version", "fingerprint", "component_id", "key", "keep", "doc", "rest", "k_doc", "k_version", "word", "row", "n_tokens", "place", "own"]
    rows = documents(
        (1, "Some words of a text. And more of them, too.", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, " \n\t ", "de"),
        (5, "lang und breit " * 20_000, "de"),
        (6, "x" * 50_000, None),
        (7, "Some words of a text. And more of them, too.", "en"),
        (7, "Some words of a text. And more of them, too.", "en"),
        (None, "Some words of a text. And more of them, too.", None),
        (None, None, None),
        (7, "another text of the same id", "en"),
        (8, "\u00c9t\u00e9 \U0001f642 \ud7ff 123 !?", "fr"),
    )
    return rows.select("*", *[F.lit("clash").alias(name) for name in clashing])
