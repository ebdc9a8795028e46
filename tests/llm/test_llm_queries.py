import pytest

from brookwave.llm.queries import QUERIES, SQL
from tests.comparing import SF, compare, connected


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(QUERIES[name](spark, SF), SQL[name], connected())
