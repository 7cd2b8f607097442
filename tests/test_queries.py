"""Every engine query against its SQL on the smallest tables, and that it stays narrow where it should."""

import glob
import os

import duckdb
import pytest

from quillmill.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got)
    rows = lambda x: sorted(map(repr, x[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_pipeline_does_not_shuffle(spark):
    plan = queries.pipeline_full(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # at most the one that deals out a small file
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") <= 1 and plan.count("ArrowEvalPython") == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
