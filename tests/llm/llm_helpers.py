"""Small tables with every awkward case, and brute force."""

import os

import pytest

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, start=0, base="w"):
    return " ".join(f"{base}{i}" for i in range(start, start + n))


def awkward_docs(spark):
    """NULLs in every column, empty and long texts, repeated rows and ids."""
    long_text = words(30_000, base="lang")
    rows = [
        (1, words(60), "en", "a", 1), (2, words(60), "en", None, None), (2, words(60), "en", None, None),
        (3, None, "en", "a", 0), (4, "", None, "a", 0), (5, "  \n\t ", "fr", "b", 5), (None, words(40, 500), "fr", "b", 3),
        (6, long_text, "de", "b", 9), (7, "ein", "de", "c", 3), (8, "12 34 !!", None, "c", 2), (9, words(59) + " other", "en", "c", 1),
        (10, "na " * 50, "en", "a", 1), (11, "été çà où déjà très près élève", "fr", "z", 2),
    ]
    return spark.createDataFrame(rows, DOCS)
