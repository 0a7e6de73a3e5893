import pytest
from oracle import assert_equal, database

from docfacts.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    assert_equal(queries.queries()[name](spark, sf), database(sf), queries.oracle_sql()[name])
