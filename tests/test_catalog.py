"""All registered queries against their SQL at the smallest scale."""

import os

import duckdb
import pytest

from checks import catalog

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, SF_DIR)
    result = con.execute(catalog.ORACLES[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == sorted(df.columns)
    ours = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert ours == sorted(result.fetchall(), key=repr)
