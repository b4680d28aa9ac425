"""Every query with SQL gives the rows DuckDB gives, over the whole small tables."""

import glob
import os

import duckdb
import pytest
from corpusgauge import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def flat(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.5f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(flat, v)) + "]"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    try:
        return f"{float(v):.5f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sql, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(flat(r[c]) for c in columns) for r in df.collect())
    if name not in plans.oracle_sql():
        return
    answer = sql.execute(plans.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(flat(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(plans.oracle_sql()) <= set(plans.queries())
