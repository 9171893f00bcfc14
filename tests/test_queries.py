"""Every registered query that has SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from quern.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(value, r)) for r in df.select(columns).collect()), key=str)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert got == sorted((tuple(map(value, r)) for r in want), key=str)


