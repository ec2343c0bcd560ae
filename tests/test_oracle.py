"""Every query of the analysis against its SQL in DuckDB."""

import duckdb
import pytest
from recordlens import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return connection


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    found = duck.sql(queries.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    want = [tuple(plain(r[k]) for k in at) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
