import pytest
from oracle import compare

from weirflow.plans import catalogue, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, name):
    q = registry.QUERIES[name]
    compare(spark, q.run, q.sql, SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
