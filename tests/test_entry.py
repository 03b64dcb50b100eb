"""Driver contract: entry runs, every query has a callable, oracles are a subset."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["data_source", "customer_name"]


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_every_query_builds_on_smoke_data(spark):
    for name, fn in E.QUERIES.items():
        df = fn(spark, E.SMOKE_DIR)
        assert df.columns, name
