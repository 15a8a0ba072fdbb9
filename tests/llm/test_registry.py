import pytest
from lexiforge.llm.registry import QUERIES, SQL

from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, name):
    assert compare(QUERIES[name](spark, DATA), connect(DATA), SQL[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
