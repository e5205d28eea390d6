import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))


@pytest.fixture(scope="session")
def rich(spark):
    """Documents with nulls, ties, repeated rows and columns whose names clash with those of the operators."""
    rows = [
        (3, "one two three four five six", "en", 1, "x"),
        (3, "one two three four five six", "en", 1, "x"),
        (1, None, None, None, None),
        (None, "no number here at all today", "en", 2, "y"),
        (2, "", "de", 0, "z"),
        (5, " \n\t ", None, 4, "z"),
        (7, "One two three four five SIX", "en", 4, "z"),
        (-4, "idiot " * 3000, "en", 4, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, component_id string")
