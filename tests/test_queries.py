"""Every registered query against its SQL."""

import pytest
from helpers import DATA, same_rows

import isohyet.plans.queries_chains
import isohyet.plans.queries_graph
import isohyet.plans.queries_io
import isohyet.plans.queries_rows
import isohyet.plans.queries_sets
import isohyet.plans.queries_sources
import isohyet.plans.queries_tables  # noqa: F401
from isohyet.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    out = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.SQL:
        same_rows(out, duck.execute(registry.SQL[name]).fetchdf())
    else:
        assert len(out)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
