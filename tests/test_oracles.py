"""Every query of the library proper against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import specgrid.plans.file_queries
import specgrid.plans.geo_queries
import specgrid.plans.pixel_queries
import specgrid.plans.stream_queries
import specgrid.plans.table_queries  # noqa: F401
from specgrid.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    told = duck.execute(SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in told.fetchall())
