"""Queries of the subpackage against their SQL."""

import pytest

from panelmill.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    result = con.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    found = queries.QUERIES[name](spark, sf)
    assert set(found.columns) == set(columns)
    expected = sorted((tuple(row) for row in result.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == expected
