"""The registered queries against their SQL."""

import duckdb
import pytest

from quillon.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    return tuple(value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    ran = oracle.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in ran.description]
    want = sorted(repr(tuple(map(plain, r))) for r in ran.fetchall())
    got = catalogue.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(map(plain, r))) for r in got.select(*columns).collect()) == want
