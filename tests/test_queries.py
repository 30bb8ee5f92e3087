import pytest
from conftest import DATA

from spindrift.plans import queries, registry, run_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, spark, same):
    same(registry.QUERIES[name](spark, DATA), registry.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
