"""The training-data queries against their SQL."""

import os

import pytest

from vellumine.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [list(rel.columns).index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
