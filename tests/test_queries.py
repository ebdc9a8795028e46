import pytest

from brookwave.queries import QUERIES, SQL
from tests.comparing import SF, compare, connected


@pytest.fixture(scope="module")
def duck():
    return connected()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    compare(QUERIES[name](spark, SF), SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
