"""Scores whose exact decimals end in a 5 beyond the last place: rounded as the SQL rounds them."""

import duckdb
import pytest
from recordlens import queries

#: Turns of conversations: role, characters, and whether the word of the votes occurs.
TALKS = {
    221: [("system", 332, 1), ("user", 213, 1), ("assistant", 1470, 1), ("user", 154, 1), ("assistant", 1009, 1)],
    1433: [("system", 121, 1), ("user", 292, 1), ("assistant", 924, 1), ("user", 281, 1)],
    2032: [("system", 213, 1), ("user", 162, 0), ("assistant", 690, 1), ("user", 38, 0), ("assistant", 483, 1)],
    2341: [("system", 274, 0), ("user", 266, 0), ("assistant", 1381, 0), ("user", 325, 0)],
    8424: [("system", 110, 1), ("user", 100, 1), ("assistant", 376, 1), ("user", 27, 1)],
    15097: [("system", 302, 0), ("user", 209, 0), ("assistant", 717, 0), ("user", 112, 0)],
    24916: [("system", 88, 1), ("user", 96, 0), ("assistant", 140, 1), ("user", 347, 1)],
}


@pytest.mark.parametrize("name", ["role_score", "role_cascade"])
def test_halves_as_in_sql(spark, tmp_path, name):
    rows = [(k, turn, role, "the ".ljust(n, "x") if says else "x" * n) for k, turns in TALKS.items() for turn, (role, n, says) in enumerate(turns)]
    place = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(place)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{place}/*.parquet')")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = duck.sql(queries.ORACLE_SQL[name])
    assert df.columns == list(want.columns)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)
