import os

import duckdb
import pytest

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in os.listdir(SF):
        c.execute(f"create view {x.split('.')[0]} as select * from '{SF}/{x}'")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(map(repr, pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
