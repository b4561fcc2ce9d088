"""The entry module, and every graph query against its oracle at the smallest size."""

import __spark_entry__ as entry_module
import oracle
import pytest

from treeloom.plans import queries as graph_queries


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["id", "type", "label", "distance"] and df.count() > 10


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(graph_queries.ORACLES) == set(graph_queries.QUERIES)


@pytest.mark.parametrize("name", list(graph_queries.QUERIES))
def test_query_equals_its_oracle(spark, sf, name):
    oracle.same(spark, graph_queries.QUERIES[name], graph_queries.ORACLES[name], sf)


def test_public_names():
    import treeloom

    assert all(callable(getattr(treeloom, name)) for name in treeloom.__all__)
