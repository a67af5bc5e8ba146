import os

import duckdb
import pytest

import __spark_entry__ as entry
from timberline import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def _cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return repr(round(float(v), 9) + 0.0) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).columns == ["event_type", "eval_ts", "value"]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = df.collect()
    sql = queries.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())
