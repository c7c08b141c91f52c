"""Every registered cube query against its SQL on the smallest tables."""

import pytest

from gridloom import catalog_queries as cq

from . import oracle


@pytest.mark.parametrize("name", sorted(cq.ORACLE))
def test_query_equals_sql(spark, sf, name):
    oracle.check(spark, sf, cq.QUERIES[name], cq.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(cq.QUERIES) - set(cq.ORACLE)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert cq.QUERIES[name](spark, sf).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
