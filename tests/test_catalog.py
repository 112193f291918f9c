"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

from siftwright.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert not oracle.differences(spark, con, QUERIES[name], ORACLE_SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
