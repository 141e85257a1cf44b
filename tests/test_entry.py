"""Every query against its SQL, over the smallest tables, and the contract of the entry module."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_is_its_sql(spark, tables, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_entry_gives_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_queries_without_sql_run(spark):
    for name in entry.queries().keys() - entry.oracle_sql().keys():
        assert entry.queries()[name](spark, str(DATA)).count() >= 0
