import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tablewright.session import build_session  # noqa: E402

#: Rows that every operator must take: no text, no words, white space of all kinds, one word, one long run, equal rows, no id.
ODD = [
    (None, "a b c d e f"),
    (None, None),
    (900_000, None),
    (900_001, ""),
    (900_002, " \t\n\x0b\x0c\r "),
    (900_003, "x " * 3000),
    (900_004, "alone"),
    (900_005, "same words here in two rows, and quite enough of them to count\nsecond line of it"),
    (900_005, "same words here in two rows, and quite enough of them to count\nsecond line of it"),
    (900_006, "Ünïcode ß  two  blanks and ́marks <|endoftext|> 한국어 \n\n x"),
]


@pytest.fixture(scope="session")
def spark():
    session = build_session("llm tests", 8, 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def rows(spark):
    """Given documents and the odd rows, as (doc_id, text)."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return [tuple(r) for r in given.collect()] + ODD


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The same as a table with columns of clashing names."""
    made = [(i, t, 1, "k", b"b", "n") for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, block long, key string, body binary, node string").repartition(5).cache()
