"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from framewise.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_against_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    r = db.sql(catalogue.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    want = sorted(tuple(plain(x[r.columns.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted(tuple(plain(x[c]) for c in cols) for x in df.collect()) == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    got = df.collect()
    assert len(got) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert {r.status for r in got} <= {"ready", "rescued", "rejected_local", "mirrored", "unpaired"}
    by = {}
    for r in got:
        if r.status in ("mirrored", "unpaired"):  # copies that follow their originals
            continue
        by.setdefault(r.scene_id, []).append(r.status)
    assert all(s.count("ready") <= 3 and (s.count("rescued") <= (0 if "ready" in s else 1)) for s in by.values())
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(catalogue.ORACLES) <= set(__spark_entry__.oracle_sql())
