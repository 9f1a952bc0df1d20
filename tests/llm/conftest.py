from __future__ import annotations

import pytest

LONG = "wörter and Words " * 9000
P = "this passage is more than fifty bytes long and it stands in several documents"
#: doc_id, text, lang, source, and columns whose names operators use themselves.
ROWS = [
    (1, "Hello World, this is a text", "en", "a", 1, "x", 5, 0),
    (2, "hello world, THIS is a text", "en", "a", 2, None, 5, 0),
    (3, None, None, None, None, "x", 5, 0),
    (4, "", "en", None, 4, "x", 5, 0),
    (5, " \t\n", "en", "b", 5, "x", 5, 0),
    (6, LONG, "de", "b", 6, "x", 5, 0),
    (7, LONG + "end", "de", "b", 7, "x", 5, 0),
    (8, "1234 5678 !!! ###", None, "c", 8, "x", 5, 0),
    (9, f"start {P} one", "en", "c", 9, "x", 5, 0),
    (10, f"other words {P} two", "en", "c", 10, "x", 5, 0),
    (10, f"other words {P} two", "en", "c", 10, "x", 5, 0),
    (None, f"no id {P}", "fr", "c", 11, "x", 5, 0),
    (11, "É é Ünïcode ünïcode \u0000 中文 🙂 end", "fr", "é", 12, "x", 5, 0),
    (12, "short", "fr", "Z", 13, "x", 5, 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, row_id int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, long texts, repeated rows, and columns with clashing names."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf01():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
