"""The small fitted paths against their DuckDB equivalents."""

import math

import duckdb
import pytest

from ridgeline import fit_queries, queries

NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == fit_queries.__name__]
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", NAMES)
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    made = queries.QUERIES[name](spark, DATA)
    assert sorted(made.columns) == sorted(columns)
    got = sorted(map(tuple, made.select(*columns).collect()), key=str)
    for a, b in zip(got, sorted(want.fetchall(), key=str), strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-5) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))
