"""Every query runs on the smallest tables, and agrees with its SQL."""

import pytest
from compare import same

from millrace.plans.everything import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(name, spark, small, duck):
    same(QUERIES[name](spark, small), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, small):
    df = QUERIES[name](spark, small)
    assert df.count() > 0 and df.columns


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
