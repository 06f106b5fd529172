"""Every registered core query against its SQL on the smallest tables."""

import pytest

from compare import both
from parley.plans import registry


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) & set(registry.SQL)))
def test_query_equals_sql(spark, small, name):
    mine, theirs = both(spark, registry.QUERIES[name], registry.SQL[name], small)
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]


def test_entry_and_names(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_queries_without_sql_run(spark, small):
    for name in sorted(set(registry.QUERIES) - set(registry.SQL)):
        assert registry.QUERIES[name](spark, small).count() >= 0
