"""Every registered query against its SQL on the small tables; the others must return rows."""

import pytest
from compare import connect, differences

import __spark_entry__ as repo

SF = "/root/testdata/sf0.001"
QUERIES, SQL = repo.queries(), repo.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if "boosting" not in n))
def test_returns_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.limit(1).count() == 1


def test_entry(spark):
    row = repo.entry(spark).first()
    assert row["variable"] == "price_z" and row["k"] == 5 and row["n"] == 1500
