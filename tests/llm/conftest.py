import pytest
from helpers import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, n int, words string, kept string, part int, a long"


def extra(rows):
    return [(*r, "k", 1, 2, "w", "no", 3, 4) for r in rows]


PROSE = "the cat sat on the mat and looked at the dog while it was in the garden with all of the birds that sing by day. "


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rows = [
        (1, None, "en", "s", 0),
        (2, "", None, None, 0),
        (3, "  \n\t ", "xx", "s", 5),
        (4, "one", "en", "s", 3),
        (5, PROSE, "en", "s", 1),
        (6, PROSE, "en", "s", 1),
        (6, PROSE, "en", "s", 1),
        (7, PROSE.upper() + "extra", "de", "t", 1),
        (None, PROSE + "tail", "en", "s", 1),
        (None, None, None, None, None),
        (8, "word " * 60_000, "en", "s", 1),
        (9, "one two three", "fr", "s", 1),
        (-5, "É日本 <|endoftext|> x\x0by\r\nz  q", "fr", "s", 1),
    ]
    return spark.createDataFrame(extra(rows), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
