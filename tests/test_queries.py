import duckdb
import pytest

import __spark_entry__
from tilewise import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "lineitem part orders events embeddings documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    order = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    assert order(got).equals(order(want).astype(got[cols].dtypes.to_dict()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
