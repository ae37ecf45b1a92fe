"""Every registered query runs, and gives what its SQL gives, on the smallest tables."""

import math

import duckdb
import pytest

from seqloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(cols, data):
    return sorted(repr(tuple(r[c] for c in cols)) for r in data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [r.asDict() for r in df.collect()]
    if name in queries.SQL:
        want = db.sql(queries.SQL[name])
        assert sorted(want.columns) == cols
        assert rows(cols, got) == rows(cols, [dict(zip(want.columns, r)) for r in want.fetchall()])
    else:
        assert all(x is not None and not (isinstance(x, float) and math.isnan(x)) for r in got for x in r.values())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
