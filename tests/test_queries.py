from __future__ import annotations

import pytest
from oracle import against_sql

from rallygrid.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark):
    sf_dir = "/root/testdata/sf0.01"
    df = queries.queries()[name](spark, sf_dir)
    sql = oracles.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    got, want = against_sql(df, sql, sf_dir)
    assert got[0] == want[0]
    assert got[1] == want[1] and sum(got[1].values()) > 0
