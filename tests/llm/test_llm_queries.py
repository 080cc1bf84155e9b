import pytest

from crumbtrail.llm import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, folder, name):
    same(spark, folder, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, folder, name):
    registry.QUERIES[name](spark, folder).collect()
