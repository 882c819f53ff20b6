"""The operators' queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from ravine.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "sales", "client_changes"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
    at = [want.columns.index(n) for n in names]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
