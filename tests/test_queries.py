import pytest

import __spark_entry__ as entry
from crumbtrail.plans import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, folder, name):
    same(spark, folder, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, folder, name):
    assert registry.QUERIES[name](spark, folder).count() > 0


def test_entry(spark, folder):
    df = entry.entry(spark)
    assert df.columns[0] == "business_id" and df.count() > 0


def test_core_queries_survive_a_broken_subpackage(monkeypatch):
    def broken(name):
        raise ImportError(name)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.warns(UserWarning):
        assert set(entry.queries()) == set(registry.QUERIES)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
