"""The queries of the training-data operators against their SQL on the smallest tables."""

import glob
import os

import pytest

from sparkloom.llm import queries
from tests.test_catalogue import DATA, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(queries.queries()[name](spark, DATA).toPandas()) == rows_of(duck.execute(queries.oracle_sql()[name]).df())
