"""Every catalogue query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from sparkloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows_of(df):
    cols = sorted(df.columns)
    cell = lambda v: "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT" else f"{v:.6f}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(catalogue.queries()[name](spark, DATA).toPandas()) == rows_of(duck.execute(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_strict_match_raises_on_an_unmatched_key(spark, tmp_path):
    spark.createDataFrame([(1, "n", 7), (2, "m", 8)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(7, "r")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    with pytest.raises(Exception, match="unmatched key 8"):
        catalogue.queries()["strict_match"](spark, str(tmp_path)).collect()
