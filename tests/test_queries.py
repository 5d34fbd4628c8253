"""Every image query against its SQL on DuckDB, with the driver's columns and values."""

import duckdb
import pytest

from fotolake.plans.files import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(str, (tuple(r) for r in cur.fetchall())))
    got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    assert len(want) > 0 and got == want
