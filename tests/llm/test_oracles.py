from __future__ import annotations

import oracle
import pytest

from siftwright.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert not oracle.differences(spark, oracle.connect(sf_dir), QUERIES[name], ORACLE_SQL[name], sf_dir)
