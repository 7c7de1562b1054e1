from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and a clashing extra column."""
    long = "Some words stand here, and more follow after them. " * 400
    line = "this very line stands in many of the documents"
    rows = [
        (1, f"{line}\nalpha beta gamma delta epsilon", "en", "a", "x"), (2, f"{line}\n\nother", None, None, "x"), (3, f"  {line.upper()} \nlast", "en", "b", None),
        (4, None, "en", "a", "y"), (5, "", "de", "b", "y"), (5, "", "de", "b", "y"), (6, long, "en", None, "z"), (7, long + " end", "en", "a", "z"),
        (8, "é ü ß " * 60, "fr", "c", "z"), (None, "no id here but some words to see", "en", "a", "z"), (9, "<|endoftext|> tail", "en", "c", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string")
