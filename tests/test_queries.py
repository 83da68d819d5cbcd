"""Every core query against its SQL on the smallest tables, and that the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from weirmill.tables import TABLES

FOLDER = "/root/testdata/sf0.001"
CORE = [n for n in entry.queries() if not n.startswith("p") or n.startswith(("p3_", "prs_"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{FOLDER}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return "None" if value is None else str(value)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rows, columns = df.collect(), sorted(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    got = duck.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == expected
