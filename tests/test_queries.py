"""Every registered query beside its reference SQL, and the contract of the entry file."""

import pytest

import __spark_entry__ as entry
from compare import difference, open_tables


@pytest.fixture(scope="module")
def con(sf_dir):
    return open_tables(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_reference(spark, sf_dir, con, name):
    assert difference(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_reference_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.search_name for r in rows} == {"Remote", "Paris", "Everything"}
    assert all(r.jobs_found >= r.jobs_new >= r.jobs_notified for r in rows)
