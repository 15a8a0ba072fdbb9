import pytest
from lexiforge.plans import reports, selections, structures  # noqa: F401
from lexiforge.plans.catalogue import QUERIES, SQL

from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, con, name):
    assert compare(QUERIES[name](spark, DATA), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
