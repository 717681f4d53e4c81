"""Every query with an oracle gives the oracle's rows; those without give rows."""

from __future__ import annotations

import duckdb
import pytest
from paths import SF

from shoal.queries import ORACLE_SQL, QUERIES
from shoal.sources.views import BASE


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in BASE:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(tuple(repr(r[c]) for c in cols) for r in got.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(repr(r[k]) for k in at) for r in want.fetchall())


def test_oracles_have_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
