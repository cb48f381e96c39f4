"""The queries against their SQL."""

import duckdb
import pytest

from framewise.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    want = sorted(tuple(str(x[r.columns.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted(tuple(str(x[c]) for c in cols) for x in df.collect()) == want
