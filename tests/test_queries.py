"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from faultline.operators.stage import staging
from faultline.plans import oracles, registry

SF = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    with staging(spark):
        got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, con.execute(SQL[name]).df()) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
