import glob
import os

import duckdb
import pytest


@pytest.fixture(scope="session")
def small():
    """The smallest tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


#: Rows with a null key, null and empty texts, repeats, a long text, odd characters, and columns with clashing names.
ODD = [
    (1, "the same text of some words here", "en"),
    (2, "the same text of some words here", None),
    (2, "the same text of some words here", "en"),
    (None, "the same text of some words here", "en"),
    (3, None, "de"),
    (4, "", None),
    (None, None, None),
    (5, " \n\t ", "fr"),
    (6, "word " * 30_000, "en"),
    (7, "don't 漢字 é 🙂 <|endoftext|> ▁x　y 'S 's", "zh"),
    (8, "x", "en"),
]
SCHEMA = "doc_id long, text string, lang string, ids string, id long, n long, name string, run string, digest string, row long, k string, t string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(a, b, c, "x", 9, 1, "n", "r", "d", 0, "k", "t") for a, b, c in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
