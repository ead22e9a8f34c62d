"""Every registered query with SQL gives the same rows in DuckDB (the corpus queries are in tests/llm)."""

import math
import os

import duckdb
import pytest

from wayloom import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return repr(float(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, duck):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    assert rows
    if name in plans.ORACLES:
        want = duck.sql(plans.ORACLES[name])
        assert sorted(want.columns) == columns
        order = [want.columns.index(c) for c in columns]
        assert rows == sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
