import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A documents table from (doc_id, text) pairs, or longer rows."""

    def build(rows, schema=SCHEMA):
        rows = [tuple(r) + (None,) * (5 - len(r)) if schema == SCHEMA else r for r in rows]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{k % 997} of part{k % 13}," for k in range(9000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (None, None),
        (6, long), (7, long[: len(long) // 2]), (8, "x" * 90_000), (9, "a\x00b é ß 漢字 <|endoftext|> <|startoftext|>"), (10, "\n\n\n"),
    ]
